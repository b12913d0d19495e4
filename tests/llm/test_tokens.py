import numpy as np
import pytest
from helpers import prose

from pitchrank.llm import packing, tokencount
from pitchrank.llm.queries import QUERIES, TOKENIZERS

DOCS = "doc_id long, text string"
TEXTS = [None, "", "one", "héllo wörld " * 50, " ".join(prose(1, 3000)), "\n\n", "one"]


def test_flat_files_are_counted(spark, tmp_path):
    import base64

    import tiktoken

    ranks = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
    with open(ranks) as lines:
        encoder = tiktoken.Encoding("x", pat_str=tokencount.PATTERN, special_tokens={}, mergeable_ranks={
            base64.b64decode(a): int(b) for a, b in map(str.split, lines)})
    docs = spark.createDataFrame(list(enumerate(TEXTS)), DOCS).coalesce(1).selectExpr("*", "7 AS file")
    path = str(tmp_path / "flat")
    tokencount.write_flat(tokencount.byte_pair_ids(docs, ranks), path, 50256)
    for block in (1, 7, 1 << 19):  # documents reach over blocks, and blocks hold many
        found = sorted(tokencount.count_tokens(spark, path, 50256, block_tokens=block).collect(), key=lambda r: r.document)
        assert [r.n_tokens for r in found] == [len(encoder.encode_ordinary(t or "")) for t in TEXTS]
        assert [r.document for r in found] == list(range(len(TEXTS)))
        assert all(b.start == a.start + a.n_tokens + 1 for a, b in zip(found, found[1:]))


def test_signed_documents_are_told(spark, tmp_path):
    ids = [0, 1, -1, 2**62 + 12345, -2**63, None, 8191, 8192]
    rows = spark.createDataFrame([(i, bytearray([k, 0] * k)) for k, i in enumerate(ids)], "doc_id long, ids binary")
    tokencount.write_flat(tokencount.sign(rows), str(tmp_path / "s"), 50256)
    found = tokencount.count_tokens(spark, str(tmp_path / "s"), 50256, head=tokencount.DIGITS, block_tokens=5)
    got = [tuple(r) for r in found.select(tokencount.signature(found["head"]), "n_tokens").collect()]
    assert sorted(got, key=str) == sorted(((i, k + tokencount.DIGITS) for k, i in enumerate(ids)), key=str)


@pytest.mark.parametrize("ids, counts", [([], []), ([9], [0]), ([1, 2], [2]), ([1, 9, 9, 2, 3], [1, 0, 2]), ([9, 9], [0, 0])])
def test_odd_files(spark, tmp_path, ids, counts):
    (tmp_path / "part-00000-x").write_bytes(np.array(ids, "uint32").tobytes())
    for block in (1, 2, 100):
        found = tokencount.count_tokens(spark, str(tmp_path), 9, "uint32", block).orderBy("document").collect()
        assert [r.n_tokens for r in found] == counts


def test_best_fit_equals_the_plain_search():
    rng = np.random.default_rng(3)
    for row in (10, 64, 100):
        sizes = rng.integers(1, row + 1, 300)
        where = packing.best_fit(sizes, row)
        room: list[int] = []
        for i in np.argsort(-sizes, kind="stable"):
            fitting = [(r, k) for k, r in enumerate(room) if r >= sizes[i]]
            if not fitting:
                room.append(row)
                fitting = [(row, len(room) - 1)]
            least = min(r for r, _ in fitting)
            room[next(k for r, k in fitting if r == least)] -= sizes[i]
        used = np.bincount(where, sizes)
        assert used.max() <= row and sorted(row - used) == sorted(room)


def test_packed_rows_hold_every_document(spark, tmp_path):
    docs = spark.createDataFrame([*enumerate(TEXTS), (None, "no id")], DOCS)
    done = packing.pack(packing.byte_ids(docs), row=64, batch_tokens=500).collect()
    parts: dict = {}
    for r in done:
        ids, at, cu = np.frombuffer(r.ids, "uint16"), np.frombuffer(r.positions, "uint16"), r.cu_seqlens
        assert len(ids) == len(at) == 64 and cu[0] == 0 and cu[-1] == r.n_tokens and (ids[cu[-1]:] == packing.BYTE_END).all()
        for doc, offset, a, b in zip(r.doc_ids, r.doc_offsets, cu, cu[1:]):
            assert (at[a:b] == np.arange(b - a)).all()
            parts.setdefault(doc, []).append((offset, ids[a:b]))
    for i, t in [*enumerate(TEXTS), (None, "no id")]:
        if t is None:
            assert i not in parts
        else:
            whole = np.concatenate([p for _, p in sorted(parts[i], key=lambda x: x[0])])
            assert bytes(whole[:-1].astype("uint8")).decode() == t and whole[-1] == packing.BYTE_END
    assert packing.pack(packing.byte_ids(docs.limit(0))).count() == 0
    packing.write_matrix(packing.pack(packing.byte_ids(docs), row=64).coalesce(1), str(tmp_path / "m"))
    size = sum(f.stat().st_size for f in (tmp_path / "m").glob("part-*"))
    assert size % (65 * 2) == 0 and size > 0


def test_packing_query_packs_token_ids(spark, tmp_path):
    import base64

    import tiktoken

    with open(f"{TOKENIZERS}/byte_bpe_50k.tiktoken") as lines:
        encoder = tiktoken.Encoding("x", pat_str=tokencount.PATTERN, special_tokens={}, mergeable_ranks={
            base64.b64decode(a): int(b) for a, b in map(str.split, lines)})
    spark.createDataFrame(list(enumerate(TEXTS)), DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    parts: dict = {}
    for r in QUERIES["op8_token_packing"](spark, str(tmp_path)).collect():
        ids = np.frombuffer(r.ids, "uint16")
        assert len(ids) == packing.ROW and (ids[r.n_tokens:] == 50256).all()
        for doc, offset, a, b in zip(r.doc_ids, r.doc_offsets, r.cu_seqlens, r.cu_seqlens[1:]):
            parts.setdefault(doc, []).append((offset, ids[a:b].tolist()))
    whole = {doc: [i for _, p in sorted(found) for i in p] for doc, found in parts.items()}
    assert whole == {i: [*encoder.encode_ordinary(t), 50256] for i, t in enumerate(TEXTS) if t is not None}


def test_files_of_any_name_are_counted(spark, tmp_path):
    for name in ("train.bin", "part-00000", "sub/val.bin"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(np.array([1, 2, 9, 3], "uint16").tobytes())
    for name in ("_SUCCESS", ".train.bin.crc"):
        (tmp_path / name).write_bytes(b"odd")
    found = tokencount.count_tokens(spark, str(tmp_path), 9).collect()
    assert sorted((r.file.split("/")[-1], r.n_tokens) for r in found) == [
        (n, k) for n in ("part-00000", "train.bin", "val.bin") for k in (1, 2)]
