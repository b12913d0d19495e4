"""Language of texts, by spans: script ranges, word scores and a Viterbi pass.

A word is a run of letters of one script (a Unicode range), longer ones in parts of ``LONG``
letters, so texts without blanks have many. Its script leaves the languages seen in that
script. Within them a word is scored by its character n-grams, naive Bayes with counts
learned from labelled texts. Over the words of a text a Viterbi pass finds the best
sequence of languages, where each change of language costs ``SWITCH``; so single odd words
do not tear a passage apart and passages in another language are found. The text's
language is the one that holds most of its letters.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchrank.llm.labels import pick
from pitchrank.llm.textbytes import ALNUM, U, Words, bounded, buffers, find_words, mix, slices, word_hashes
from pitchrank.session import materialize

MOST_ROWS = 8_000   # labelled texts learned from, at most
SLOTS = 1 << 15     # hashed n-grams
GRAMS = (1, 2, 3, 4)
SWITCH = 6.0        # cost of a change of language between two words, in log odds
LONG = 24           # letters after which a word is cut; the rest is a word of its own
# First code points of the script ranges told apart (fixed values of the Unicode blocks):
# Latin, Greek, Cyrillic, Armenian, Hebrew, Arabic, Indic, Thai and neighbours, Georgian,
# Hangul Jamo, further Latin and Greek, kana, CJK, Hangul, and the rest.
SCRIPTS = (0x0000, 0x0370, 0x0400, 0x0530, 0x0590, 0x0600, 0x0900, 0x0E00, 0x10A0, 0x1100, 0x1E00, 0x2000,
           0x3040, 0x3100, 0xAC00, 0xD7B0)
FOLDED = {10: 0}    # further Latin counts as Latin


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray    # slots x languages: log probability of each n-gram
    scripts: np.ndarray   # scripts x languages: whether the language was seen in the script


@dataclass
class Letters:
    """Words of letters of a batch: code points end to end, and where each word begins."""

    codes: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    script: np.ndarray


def _letters(column, kinds: tuple[np.ndarray, np.ndarray]) -> tuple[Words, np.ndarray, Letters, np.ndarray]:
    """Words with a letter, where each text's begin, and the letters of the different ones with each word's number.

    Runs of bytes that may be letters are found first; the different ones are then cut by
    code points: at all that is no letter, mark or format character, where the script
    changes, and after every ``LONG`` letters.
    """
    lowered = pa.array([None if t is None else t.lower() for t in column.to_pylist()], pa.string())
    runs = find_words(*buffers(lowered), _WORD)
    _, lead, which = np.unique(word_hashes(runs), return_index=True, return_inverse=True)
    raw = [runs.data[a:b].tobytes().decode() for a, b in zip(runs.start[lead], runs.end[lead], strict=True)]
    codes = np.frombuffer("".join(raw).encode("utf-32-le"), np.uint32) if raw else np.zeros(0, np.uint32)
    run = np.repeat(np.arange(len(raw)), [len(w) for w in raw])
    kind = kinds[1][np.searchsorted(kinds[0], codes, "right") - 1]
    codes, run, cut = (x[kind != _INSIDE] for x in (codes, run, kind == _CUT))
    script = np.searchsorted(SCRIPTS, codes, "right") - 1
    for a, b in FOLDED.items():
        script[script == a] = b
    new = np.ones(len(codes), bool)
    new[1:] = (run[1:] != run[:-1]) | cut[:-1] | (script[1:] != script[:-1])
    inner = np.arange(len(codes)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    codes, run, script, inner = (x[~cut] for x in (codes, run, script, inner))  # a cut is the last of its stretch
    begin = np.flatnonzero(inner % LONG == 0)
    parts = np.bincount(run[begin], minlength=len(raw))
    n = parts[which]
    text = np.repeat(runs.text_of(), n)
    number = np.repeat((np.cumsum(parts) - parts)[which] - (np.cumsum(n) - n), n) + np.arange(len(text))
    first = np.searchsorted(text, np.arange(runs.n + 1))
    return runs, first, Letters(codes, begin, np.diff(begin, append=len(codes)), script[begin]), number


_WORD = ALNUM.copy()
_WORD[48:58] = False  # digits part words
_LETTER, _INSIDE, _CUT = 0, 1, 2


@cache
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """First code points of stretches of one kind, and the kinds: a letter, a mark or format character
    inside a word, or what parts words. Built on the driver; functions for the workers carry it."""
    kind = {"L": _LETTER, "M": _INSIDE, "Cf": _INSIDE}
    names = [unicodedata.category(chr(c)) for c in range(0x110000)]
    every = np.array([kind.get(n, kind.get(n[0], _CUT)) for n in names], np.uint8)
    first = np.flatnonzero(np.diff(every, prepend=255))
    return first.astype(np.uint32), every[first]


def _grams(letters: Letters) -> tuple[np.ndarray, np.ndarray]:
    """(word, slot) of every n-gram of the words, a word standing between two marks."""
    size = letters.size
    wide = np.where(size > 0, size + 2, 0)
    at = np.cumsum(wide) - wide
    flat = np.zeros(int(wide.sum()), U)  # 0 marks both ends
    owner = np.repeat(np.arange(len(size)), size)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    flat[at[owner] + 1 + inner] = letters.codes[letters.begin[owner] + inner].astype(U) + U(1)
    word_of = np.repeat(np.arange(len(size)), wide)
    words, slots = [], []
    key = np.zeros(len(flat), U)
    for n in range(1, max(GRAMS) + 1):
        key = key[:len(flat) - n + 1] * U(0x100000001B3) + flat[n - 1:] + U(n)
        if n in GRAMS and len(key):
            whole = word_of[:len(key)] == word_of[n - 1:]
            words.append(word_of[:len(key)][whole])
            slots.append((mix(key[whole]) >> U(64 - 15)).astype(np.int64))
    return (np.concatenate(words), np.concatenate(slots)) if words else (np.zeros(0, np.int64),) * 2


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", most_rows: int = MOST_ROWS,
        id_col: str = "doc_id") -> Model:
    """Learns from texts with a language; others teach nothing.

    If there are more than ``most_rows``, a hash of the id picks about that many. Their
    n-grams are counted by Spark; what comes back is a table of SLOTS x languages.
    """
    rows = pick(labelled.where(F.col(lang_col).isNotNull()), most_rows, id_col).where(
        F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sample = materialize(rows.repartition(max(1, most_rows // 500)), "labelled")
    counts = sample.mapInArrow(_counter(_kinds()), "lang string, slot int, script int, n long").groupBy(
        "lang", "slot", "script").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(counts.column("lang").to_pylist()))
    number = {name: i for i, name in enumerate(languages)}
    lang = np.array([number[x] for x in counts.column("lang").to_pylist()], np.int64)
    slot, script, n = (counts.column(c).to_numpy() for c in ("slot", "script", "n"))
    seen = np.zeros((SLOTS, len(languages)))
    scripts = np.zeros((len(SCRIPTS), len(languages)))
    is_gram = slot >= 0
    np.add.at(seen, (slot[is_gram], lang[is_gram]), n[is_gram])
    np.add.at(scripts, (script[~is_gram], lang[~is_gram]), n[~is_gram])
    total = seen.sum(axis=0)
    scores = np.log(seen + 0.5) - np.log(total + 0.5 * SLOTS)
    # a script counts for a language if it holds more than a thousandth of its words
    return Model(languages, scores.astype(np.float32), scripts > scripts.sum(axis=0) / 1000)


def _counter(kinds: tuple[np.ndarray, np.ndarray]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 2 << 20):
            names = np.array(part.column("lang").to_pylist(), object)
            for name in sorted(set(names)):
                own = part.filter(pa.array(names == name))
                _, _, letters, which = _letters(own.column("text"), kinds)
                often = np.bincount(which, minlength=len(letters.size))
                word, slot = _grams(letters)
                grams = np.bincount(slot, often[word], SLOTS).astype(np.int64)
                scripts = np.bincount(letters.script, often * (letters.size > 0), len(SCRIPTS)).astype(np.int64)
                some, used = np.flatnonzero(grams), np.flatnonzero(scripts)
                yield pa.RecordBatch.from_arrays([
                    pa.array([name] * (len(some) + len(used)), pa.string()),
                    pa.array(np.concatenate([some, np.full(len(used), -1)]), pa.int32()),
                    pa.array(np.concatenate([np.zeros(len(some), int), used]), pa.int32()),
                    pa.array(np.concatenate([grams[some], scripts[used]]), pa.int64())],
                    names=["lang", "slot", "script", "n"])

    return run


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
    """Best language of each word; texts (``first``: where their words begin) advance side by side."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    begin, n = first[:-1][order], n[order]
    out = np.zeros(len(scores), np.int64)
    if not len(scores):
        return out
    stay = np.ones(scores.shape, bool)
    jump = np.zeros(len(scores), np.int32)
    longest = int(n[0])
    alive = np.searchsorted(-n, -np.arange(1, longest + 1), "right")  # texts with a word at each step
    value = scores[begin[:alive[0]]].copy()
    ends = np.zeros(len(n), np.int64)
    for step in range(longest):
        live = alive[step]
        if step:
            value = value[:live]
            top = value.argmax(axis=1)
            best = value[np.arange(live), top] - switch
            at = begin[:live] + step
            kept = value >= best[:, None]
            stay[at], jump[at] = kept, top
            value = np.where(kept, value, best[:, None]) + scores[at]
        gone = alive[step + 1] if step + 1 < longest else 0
        ends[gone:live] = value[gone:live].argmax(axis=1)
    state = ends
    for step in range(longest - 1, -1, -1):
        live = alive[step]
        at = begin[:live] + step
        out[at] = state[:live]
        held = stay[at, state[:live]]
        state[:live] = np.where(held, state[:live], jump[at])
    return out


def identify(docs: DataFrame, model: Model, text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``spans``.

    ``lang_pred`` is the language that most letters are in, ``score`` its share of them
    (ties go to the language that sorts first). ``spans`` lists the runs of one language as
    (lang, first, last) positions among the words that have a letter. A null text and a
    text without letters have the language ``und``, the score 0 and no spans; so has every
    text if nothing was learned. One row comes back for each row; columns named like an
    added one are replaced.
    """
    docs = bounded(docs).drop("lang_pred", "score", "spans")
    kinds = _kinds()
    span = [("lang", pa.string()), ("first", pa.int32()), ("last", pa.int32())]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.languages)
        names = np.array([*model.languages, "und"], object)
        for part in slices(batches, text_col, 2 << 20):
            _, first, letters, which = _letters(part.column(text_col), kinds)
            if not k:
                which, first = which[:0], first * 0
            word, slot = _grams(letters)
            score = np.stack([np.bincount(word, model.scores[slot, c], len(letters.size)) for c in range(k)],
                             axis=1) if k else np.zeros((len(letters.size), 0))
            allowed = model.scripts[letters.script] if len(letters.script) else np.zeros((0, k), bool)
            score = np.where(allowed | ~allowed.any(axis=1, keepdims=True), score, -1e4)
            path = viterbi(score[which], first, switch) if k else np.zeros(0, np.int64)
            text = np.repeat(np.arange(part.num_rows), np.diff(first))
            share = np.zeros((part.num_rows, k + 1))
            np.add.at(share, (text, path), letters.size[which])
            total = share.sum(axis=1)
            best = np.where(total > 0, share[:, :k].argmax(axis=1) if k else 0, k)
            value = np.where(total > 0, share[np.arange(len(best)), best] / np.maximum(total, 1), 0.0)
            new = np.ones(len(path), bool)
            new[1:] = (path[1:] != path[:-1]) | (text[1:] != text[:-1])
            at = np.flatnonzero(new)
            last = np.append(at[1:], len(path))[:len(at)] - 1
            items = pa.StructArray.from_arrays(
                [pa.array(names[path[at]], pa.string()), pa.array(at - first[text[at]], pa.int32()),
                 pa.array(last - first[text[at]], pa.int32())], fields=[pa.field(*f) for f in span])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(at, first).astype(np.int32)), items)
            yield part.append_column("lang_pred", pa.array(names[best], pa.string())).append_column(
                "score", pa.array(value, pa.float64())).append_column("spans", lists)

    spans = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("first", T.IntegerType()),
                                      T.StructField("last", T.IntegerType())]))
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()),
                                              T.StructField("score", T.DoubleType()), T.StructField("spans", spans)]))
