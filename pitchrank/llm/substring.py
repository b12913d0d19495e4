"""Removing passages that an earlier document already has, found by fixed-block anchors.

A window of ``size`` words always covers one whole block of ``block = (size + 1) / 2``
words if blocks are cut end to end from the start of a document. So the blocks of every
document are indexed and probed with every rolling run of ``block`` words; only where a
probe hits can a window repeat (the anchors). Each anchor is extended to all windows
around it, these are compared by a long hash of all their words, and runs of repeated
windows are merged into maximal exact repeats.

Both comparisons are a shuffle on the hash. What is shuffled is packed: one row for each
pair of a batch of documents and a hash bucket, with the batch's different hashes in one
binary value, four bytes each for probes. Repeats within a batch are folded before the
shuffle, so a passage that every document has is one entry per batch and not per
document. Buckets and batches have a bounded size at any size of the input, as their
number grows with it. Texts are shuffled once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchrank.llm.textbytes import (
    U, binaries, bounded, buffers, find_words, mix, slices, window_hashes, windows, word_hashes,
)

BATCH_BYTES = 6 << 20    # text in one batch
GROUP_BYTES = 4 << 20    # text in one group of the second comparison
BUCKET_BYTES = 12 << 20  # text whose windows one bucket holds
ADDED = ("n_words", "removed", "kept")

_ENTRIES = T.StructType([
    T.StructField("bucket", T.LongType()), T.StructField("batch", T.LongType()),
    T.StructField("kind", T.IntegerType()), T.StructField("a", T.BinaryType()),
    T.StructField("b", T.BinaryType()), T.StructField("c", T.BinaryType()), T.StructField("d", T.BinaryType()),
])
_ANCHORS = "_group long, doc_id long, _text long, at binary"
_ENTRY, _MANIFEST = 0, 1


def mark_repeats(docs: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text",
                 keep_layout: bool = False) -> DataFrame:
    """``docs`` with ``n_words``, ``removed`` and ``kept``.

    A word is removed if a window of ``size`` consecutive words of one document covers it
    and the same window also starts in a document with a smaller id. Windows are judged
    on the texts as they came. ``removed`` lists the maximal runs of removed words as
    (first, last) word positions; ``kept`` holds the other words, joined by one blank, or
    with ``keep_layout`` the text with only the removed runs cut out.

    One row comes back for each row. A null text has no words and an empty ``kept`` (null
    with ``keep_layout``); a text shorter than ``size`` words loses nothing. Rows of the
    same id never remove each other. A null id counts as larger than all others. An empty
    table gives an empty table. Input columns named like an added one are replaced; all
    others are passed through.

    ``docs`` is read several times and in the same order, so it should come from files.
    """
    docs = bounded(docs).drop(*ADDED)
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    groups, buckets = total // GROUP_BYTES + 1, total // BUCKET_BYTES + 1
    names = docs.columns
    keyed = docs.select(
        F.struct(*[F.col(c) for c in names if c != text_col]).alias("_rest"),
        F.col(text_col).alias("_body"),
        F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("doc_id"),
        F.xxhash64(text_col).alias("_text"),
    ).withColumn("_group", F.pmod(F.xxhash64("doc_id", "_text"), F.lit(groups)))

    probes = keyed.select("_group", "doc_id", "_text", "_body").mapInArrow(_probe(size, buckets), _ENTRIES)
    anchors = (probes.groupBy("bucket").applyInArrow(_match_blocks, _ENTRIES)
               .groupBy("batch").applyInArrow(_resolve_anchors((size + 1) // 2), _ANCHORS))
    candidates = (keyed.groupBy("_group").cogroup(anchors.groupBy("_group"))
                  .applyInArrow(_extend(size, buckets), _ENTRIES))
    hits = (candidates.groupBy("bucket").applyInArrow(_match_windows, _ENTRIES)
            .withColumnRenamed("batch", "_group"))
    added = T.StructType([
        keyed.schema["_rest"], T.StructField("_body", T.StringType()), T.StructField("n_words", T.LongType()),
        T.StructField("removed", T.ArrayType(T.StructType([
            T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))),
        T.StructField("kept", T.StringType()),
    ])
    done = (keyed.groupBy("_group").cogroup(hits.groupBy("_group"))
            .applyInArrow(_cut(size, keep_layout), added))
    return done.select(*[F.col("_body").alias(c) if c == text_col else F.col("_rest")[c].alias(c) for c in names],
                       *ADDED)


# ---------------------------------------------------------------- packing

def _entries(bucket: np.ndarray, batch: int, at: np.ndarray, *values: np.ndarray) -> pa.RecordBatch | None:
    """One row per bucket; ``at`` is packed as gaps of one byte with the longer ones apart."""
    if not len(bucket):
        return None
    order = np.argsort((bucket << 32) | at)
    bucket, at, values = bucket[order], at[order].astype(np.int64), [v[order] for v in values]
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    gap = np.diff(at, prepend=0)
    gap[first[:-1]] = at[first[:-1]]
    long = np.flatnonzero(gap > 254)
    small = gap.astype(np.uint8)
    small[long] = 255
    columns = [binaries(small, first), binaries(gap[long].astype(np.uint32), np.searchsorted(long, first)),
               *[binaries(v, first) for v in values]]
    n = len(first) - 1
    columns += [pa.nulls(n, pa.binary())] * (4 - len(columns))
    return _rows(bucket[first[:-1]], np.full(n, batch), np.full(n, _ENTRY), columns)


def _positions(gaps: bytes, long: bytes) -> np.ndarray:
    gap = np.frombuffer(gaps, np.uint8).astype(np.int64)
    gap[gap == 255] = np.frombuffer(long, np.uint32)
    return np.cumsum(gap)


def _manifest(bucket: int, batch: int, *parts: np.ndarray) -> pa.RecordBatch:
    cells = [pa.array([p.tobytes()], pa.binary()) for p in parts]
    cells += [pa.nulls(1, pa.binary())] * (4 - len(cells))
    return _rows(np.array([bucket]), np.array([batch]), np.array([_MANIFEST]), cells)


def _rows(bucket, batch, kind, cells) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket.astype(np.int64)), pa.array(batch.astype(np.int64)), pa.array(kind.astype(np.int32)), *cells],
        names=[f.name for f in _ENTRIES])


def _nothing() -> pa.Table:
    return pa.table({f.name: pa.array([], t) for f, t in zip(
        _ENTRIES, [pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 4], strict=True)})


def _fold(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stable order by ``key``, where each run of equal keys begins in it, and the run of each place."""
    order = np.argsort(key, kind="stable")
    in_order = key[order]
    new = np.ones(len(key), bool)
    new[1:] = in_order[1:] != in_order[:-1]
    return order, np.flatnonzero(new), np.cumsum(new) - 1


# ---------------------------------------------------------------- anchors

def _probe(size: int, buckets: int):
    """Every rolling run of words, and a mark on those that are blocks."""
    block = (size + 1) // 2

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_body", BATCH_BYTES):
            words = find_words(*buffers(part.column("_body")))
            ids, texts, groups = (part.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "_text", "_group"))
            at, text = windows(words, block)
            hashes = window_hashes(word_hashes(words), at, block)
            is_block = (at - words.first[text]) % block == 0
            bucket = ((hashes >> U(34)) % U(buckets)).astype(np.int64)
            value = (hashes & U((1 << 30) - 1)).astype(np.uint32)
            order, runs, run_of = _fold((bucket << 30) | value)
            counts = np.diff(runs, append=len(order))
            lead = order[runs]  # the first place of each value
            packed = value[lead] << np.uint32(2)
            if len(runs):
                packed |= np.logical_or.reduceat(is_block[order], runs).astype(np.uint32) << np.uint32(1)
            packed |= (counts > 1).astype(np.uint32)
            copies = np.flatnonzero(np.arange(len(order)) != runs[run_of]) if len(order) else runs
            batch = int(mix(np.array([np.bitwise_xor.reduce(mix(
                mix(ids.astype(U)) + texts.astype(U) + np.arange(len(ids), dtype=U)))], U))[0].view(np.int64))
            rows = _entries(bucket[lead], batch, lead, packed)
            if rows is not None:
                yield rows
                yield _manifest(-1 - batch % buckets, batch, np.stack([ids, texts, groups]).astype(np.int64),
                                words.first, order[copies].astype(np.int32), lead[run_of[copies]].astype(np.int32))

    return run


def _split(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    kinds = table.column("kind").to_numpy()
    return table.filter(pa.array(kinds == _ENTRY)), table.filter(pa.array(kinds == _MANIFEST))


def _match_blocks(table: pa.Table) -> pa.Table:
    """Of one bucket: the entries whose run of words is a block somewhere and occurs again."""
    entries, passed = _split(table)
    values = [np.frombuffer(x.as_py(), np.uint32) for x in entries.column("c")]
    if not values:
        return passed
    value = np.concatenate(values)
    order, runs, run_of = _fold(value >> np.uint32(2))
    flags = value[order]
    again = (np.diff(runs, append=len(order)) > 1) | (np.bitwise_or.reduceat(flags, runs) & 1 > 0)
    hit = again & (np.bitwise_or.reduceat(flags, runs) & 2 > 0)
    keep = np.zeros(len(value), bool)
    keep[order] = hit[run_of]
    return pa.concat_tables([passed, _kept(entries, keep, [len(v) for v in values])])


def _kept(entries: pa.Table, keep: np.ndarray, counts: list[int]) -> pa.Table:
    """The places of the entries marked in ``keep``, as four-byte numbers in ``a``."""
    out, at = [], 0
    for gaps, long, batch, n in zip(entries.column("a"), entries.column("b"), entries.column("batch"), counts,
                                    strict=True):
        hit = keep[at:at + n]
        at += n
        if hit.any():
            places = _positions(gaps.as_py(), long.as_py())[hit].astype(np.uint32)
            out.append((batch.as_py(), places.tobytes()))
    if not out:
        return _nothing()
    n = len(out)
    return pa.Table.from_batches([_rows(
        np.array([x[0] for x in out]), np.array([x[0] for x in out]), np.full(n, _ENTRY),
        [pa.array([x[1] for x in out], pa.binary()), *[pa.nulls(n, pa.binary())] * 3])])


def _joined(entries: pa.Table) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in entries.column("a")]).astype(np.int64)


def _resolve_anchors(block: int):
    """Of one batch: the positions of the anchors of each document that has any."""

    def run(table: pa.Table) -> pa.Table:
        entries, manifests = _split(table)
        out: list[tuple] = []
        if entries.num_rows:
            keys, first, copies, leads = (
                np.frombuffer(manifests.column(c)[0].as_py(), t)
                for c, t in (("a", np.int64), ("b", np.int64), ("c", np.int32), ("d", np.int32)))
            keys = keys.reshape(3, -1)
            hits = np.unique(_joined(entries))
            hits = np.union1d(hits, copies[np.isin(leads, hits)])
            # runs of words are numbered through the batch, text after text
            begin = np.concatenate([[0], np.cumsum(np.maximum(np.diff(first) - block + 1, 0))])
            cuts = np.searchsorted(hits, begin)
            for i in np.flatnonzero(np.diff(cuts)):
                local = hits[cuts[i]:cuts[i + 1]] - begin[i]
                out.append((*keys[:, i].tolist(), np.diff(local, prepend=0).astype(np.int32).tobytes()))
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.table({n: pa.array(v, t) for n, v, t in zip(
            ("doc_id", "_text", "_group", "at"), columns, [pa.int64()] * 3 + [pa.binary()], strict=True)}
        ).select(["_group", "doc_id", "_text", "at"])

    return run


# ---------------------------------------------------------------- windows

def _ordered(table: pa.Table) -> pa.Table:
    """Rows of a group in the order of their keys, whatever order they came in."""
    return table.take(np.lexsort((table.column("_text").to_numpy(), table.column("doc_id").to_numpy())))


def _extend(size: int, buckets: int):
    """All windows around the anchors of one group, each once, with the smallest id that has it."""

    def run(docs: pa.Table, anchors: pa.Table) -> pa.Table:
        if not docs.num_rows or not anchors.num_rows:
            return _nothing()
        docs = _ordered(docs)
        group = docs.column("_group")[0].as_py()
        ids, texts = docs.column("doc_id").to_numpy(), docs.column("_text").to_numpy()
        words = find_words(*buffers(docs.column("_body")))
        found: dict[tuple[int, int], list[bytes]] = {}
        for i, t, at in zip(*(anchors.column(c).to_pylist() for c in ("doc_id", "_text", "at")), strict=True):
            found.setdefault((i, t), []).append(at)
        block = (size + 1) // 2
        near = np.zeros(len(words.start) + 1, np.int32)  # +1 where a stretch of window starts begins, -1 behind it
        for n, key in enumerate(zip(ids.tolist(), texts.tolist(), strict=True)):
            for packed in found.get(key, ()):
                at = np.cumsum(np.frombuffer(packed, np.int32))
                base, last = words.first[n], words.first[n + 1] - words.first[n] - size
                low, high = np.maximum(at - (size - block), 0), np.minimum(at, last)
                fits = low <= high
                np.add.at(near, base + low[fits], 1)
                np.add.at(near, base + high[fits] + 1, -1)
        every, text = windows(words, size)
        place = np.flatnonzero(np.cumsum(near)[every] > 0)
        if not len(place):
            return _nothing()
        hashes = window_hashes(word_hashes(words), every[place], size, seed=size)
        owner = ids[text[place]]
        order, runs, run_of = _fold(hashes)
        # ids rise with the place, so the first of each run has the smallest
        lead = order[runs]
        later = owner[order] > owner[lead][run_of]
        copies = np.flatnonzero(np.arange(len(order)) != runs[run_of])
        rows = _entries((mix(hashes[lead]) % U(buckets)).astype(np.int64), group, place[lead], hashes[lead],
                        owner[lead])
        marks = _manifest(-1 - group % buckets, group, place[order[later]].astype(np.uint32),
                          place[order[copies]].astype(np.uint32), place[lead[run_of[copies]]].astype(np.uint32))
        return pa.Table.from_batches([rows, marks])

    return run


def _match_windows(table: pa.Table) -> pa.Table:
    """Of one bucket: the entries whose window also starts in a document with a smaller id."""
    entries, passed = _split(table)
    hashes = [np.frombuffer(x.as_py(), U) for x in entries.column("c")]
    if not hashes:
        return passed
    key = np.concatenate(hashes)
    owner = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in entries.column("d")])
    order, runs, run_of = _fold(key)
    keep = np.zeros(len(key), bool)
    keep[order] = owner[order] > np.minimum.reduceat(owner[order], runs)[run_of]
    return pa.concat_tables([passed, _kept(entries, keep, [len(h) for h in hashes])])


def _cut(size: int, keep_layout: bool):
    """Merges repeated windows to maximal runs and leaves them out of the text."""

    def run(docs: pa.Table, hits: pa.Table) -> pa.Table:
        docs = _ordered(docs)
        words = find_words(*buffers(docs.column("_body")))
        every, _ = windows(words, size)
        hit = np.zeros(len(every), bool)
        entries, marks = _split(hits)
        if entries.num_rows:
            hit[_joined(entries)] = True
        for later, copies, leads in zip(*(marks.column(c).to_pylist() for c in "abc"), strict=True):
            copies, leads = np.frombuffer(copies, np.uint32), np.frombuffer(leads, np.uint32)
            hit[copies[hit[leads]]] = True
            hit[np.frombuffer(later, np.uint32)] = True
        cover = np.zeros(len(words.start) + 1, np.int32)
        np.add.at(cover, every[hit], 1)
        np.add.at(cover, every[hit] + size, -1)
        gone = np.cumsum(cover)[:-1] > 0
        # runs end where a text ends; a window never reaches over it, but two runs may touch there
        edge = np.zeros(len(gone) + 1, bool)
        edge[words.first] = True
        begins = np.flatnonzero(gone & (np.concatenate([[True], ~gone[:-1]]) | edge[:-1]))
        ends = np.flatnonzero(gone & (np.concatenate([~gone[1:], [True]]) | edge[1:]))
        spans, kept = [], []
        cuts = np.searchsorted(begins, words.first)
        bodies = docs.column("_body").to_pylist()
        raw = words.data.tobytes()
        for i, body in enumerate(bodies):
            lo, hi = words.first[i], words.first[i + 1]
            b, e = begins[cuts[i]:cuts[i + 1]], ends[cuts[i]:cuts[i + 1]]
            spans.append([{"first": int(x - lo), "last": int(y - lo)} for x, y in zip(b, e, strict=True)])
            if keep_layout:
                kept.append(body if body is None or not len(b) else _without(body, words, lo, hi, b, e))
            else:
                kept.append(b" ".join(raw[words.start[k]:words.end[k]] for k in
                                      (np.flatnonzero(~gone[lo:hi]) + lo).tolist()).decode())
        fields = {f.name: docs.column(f.name) for f in docs.schema if f.name in ("_rest", "_body")}
        return pa.table({**fields, "n_words": pa.array(np.diff(words.first), pa.int64()),
                         "removed": pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
                         "kept": pa.array(kept, pa.string())})

    return run


def _without(body: str, words, lo: int, hi: int, begins: np.ndarray, ends: np.ndarray) -> str:
    """The text without its removed runs; a run goes with the space up to the next word."""
    base = body.encode()
    offset = int(words.start[lo]) - len(base) + len(base.lstrip(b" \t\n\v\f\r"))
    out, at = [], 0
    for b, e in zip(begins, ends, strict=True):
        out.append(base[at:int(words.start[b]) - offset])
        at = int(words.start[e + 1]) - offset if e + 1 < hi else len(base)
    return b"".join([*out, base[at:]]).decode()
