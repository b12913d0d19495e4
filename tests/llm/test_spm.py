import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from pitchrank.llm import spm
from pitchrank.llm.queries import TOKENIZERS

sentencepiece = pytest.importorskip("sentencepiece")
MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"
TEXTS = ["", " ", "a  b\nc\t ", "  x", "▁y ▁▁z", "\0a", "日本語 テキスト 😀 aé", "a" * 63, "x" * 1000, "    deep    indents\n\n\n  ok",
         "Ünïcödé ﬀ ①", "<0x0A> <s> </s> <unk>", "end\r\n;\r", "The quick brown fox, again and again and again."]


@pytest.fixture(scope="module")
def vocabulary():
    return spm.Vocabulary.load(MODEL)


def test_ids_equal_the_library(vocabulary):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    encoder = spm.Encoder(vocabulary)
    for _ in range(2):  # the second time from the words kept
        ids, first = encoder.encode(pa.array(TEXTS))
        assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [model.encode(t) for t in TEXTS]


def test_long_unbroken_words_equal_the_library(vocabulary):
    """Texts without blanks are cut where no piece reaches over, which changes no id and keeps the time in bounds."""
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    signs = "".join(chr(0x4E00 + k * 7919 % 20000) for k in range(200_000))
    mixed = "".join(f"{chr(0x4E00 + k * 31 % 9000)}日本語テキストabc" if k % 3 else "Donaudampfschifffahrt" for k in range(300))
    texts = [signs, mixed, "é" * 70 + "x" * 70 + "日" * 70, ("y" * 63 + "語") * 5, "a b " + "語x" * 40 + " c", "\u0301" * 200]
    began = time.process_time()
    ids, first = spm.Encoder(vocabulary).encode(pa.array(texts))
    assert time.process_time() - began < 20
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [model.encode(t) for t in texts]


def test_memory_of_a_batch(vocabulary):
    """Arrays of eight bytes for each byte of the text are not kept side by side; new words go through in parts."""
    rng = np.random.default_rng(7)
    known = ["".join(chr(97 + c) for c in rng.integers(0, 26, n)) for n in rng.integers(2, 9, 60_000)]
    texts = [" ".join(known[i] for i in rng.integers(0, len(known), 300)) for _ in range(2100)]
    column = pa.array(texts)
    encoder = spm.Encoder(vocabulary)
    for _ in range(2):  # all words are new at first, and then known
        tracemalloc.start()
        ids, first = encoder.encode(column)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 27 * sum(map(len, texts))
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert all(ids[first[i]:first[i + 1]].tolist() == model.encode(texts[i]) for i in range(0, 2100, 50))


def test_documents_equal_the_library(spark, vocabulary):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for row in spm.decode(spm.encode(docs, vocabulary), vocabulary).collect():
        assert row.ids == model.encode(row.text) and row.decoded == row.text


def test_round_trip_nulls_and_clashes(spark, vocabulary):
    rows = [(i, t, "old") for i, t in enumerate([*TEXTS, None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    done = {r.doc_id: r for r in spm.decode(spm.encode(docs, vocabulary), vocabulary).collect()}
    for i, text, _ in rows:
        if text is None:
            assert done[i].ids is None and done[i].decoded is None
        else:
            assert done[i].decoded == text.replace("▁", " ")
    assert spm.encode(docs.limit(0), vocabulary).count() == 0


def test_decode_of_odd_ids(spark, vocabulary):
    byte = vocabulary.bytes_[0xFF]
    rows = spark.createDataFrame([([1, 2],), ([vocabulary.unknown, 10 ** 6],), ([byte],)], "ids array<int>")
    assert [r.decoded for r in spm.decode(rows, vocabulary).collect()] == ["", "⁇⁇", "�"]


def test_unigram_takes_the_best_sum():
    pieces = ["", "▁", "a", "b", "c", "ab", "bc", "▁a", "abc"]
    scores = np.array([0, -2, -3, -3, -3, -4, -2.5, -4, -9.0])
    encoder = spm.Encoder(spm.Vocabulary(pieces, {}, 0, scores, False))
    ids, _ = encoder.encode(pa.array(["abc"]))
    assert [pieces[i] for i in ids] == ["▁a", "bc"]  # -6.5 beats every other way
