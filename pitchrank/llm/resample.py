"""Importance resampling of documents towards a target distribution.

Texts are bags of hashed word runs. The gain of a bucket is the scaled log ratio of its
share in the target texts to its share in all documents, the weight of a document the
mean gain of its features. Every document gets its weight plus a Gumbel number drawn from
its id, and the highest sums are drawn, which is sampling without replacement in
proportion to the exponential of the weights.

Exact ranks come from a parallel sort by regular sampling: the scored rows are written as
locally sorted runs, every ``step``-th row of each run is a sample, evenly spaced samples
split the line of all rows into segments, segments are exchanged and sorted locally, and
sums of the segments' row counts turn a place in a segment into a rank. Only segments that
hold drawn rows are exchanged.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchrank.llm.textbytes import ALNUM, LOWER, bounded, buffers, find_words, joined, slices
from pitchrank.session import materialize

BUCKETS = 10_000
SCALE = 1000        # gains and scores are thousandths
SAMPLES = 64        # per segment
MOST_SEGMENTS = 4096
LONG_WORD = 64      # bytes; longer features are hashed one by one
LAST_ID = (1 << 63) - 1


def _crc_table() -> np.ndarray:
    """The 256 remainders of CRC-32, from its polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


def crc32_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of ``data[start[i]:end[i]]`` for every i, all ranges advancing one byte at a time."""
    table = _crc_table()
    length = end - start
    out = np.full(len(start), 0xFFFFFFFF, np.uint32)
    todo = np.flatnonzero(length <= LONG_WORD)
    for k in range(int(length[todo].max()) if len(todo) else 0):
        todo = todo[length[todo] > k]
        out[todo] = table[(out[todo] ^ data[start[todo] + k]) & 0xFF] ^ (out[todo] >> 8)
    out ^= 0xFFFFFFFF
    for i in np.flatnonzero(length > LONG_WORD):
        out[i] = zlib.crc32(data[start[i]:end[i]].tobytes())
    return out.astype(np.int64)


def features(column: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text of every run of 1 to ``longest`` words of the texts, and each text's number of words.

    Words are runs of ASCII letters and digits and of characters beyond ASCII, with A-Z in
    lower case; the words of a run are joined by one blank.
    """
    data, off = buffers(column)
    words = find_words(LOWER[data], off, ALNUM)
    flat, begin = joined(words)
    text, last = words.text_of(), words.first[1:]
    bucket, owner = [], []
    for size in range(1, longest + 1):
        at = np.flatnonzero(np.arange(len(text)) + size <= last[text])
        bucket.append(crc32_ranges(flat, begin[at], begin[at + size] - 1) % buckets)
        owner.append(text[at])
    return np.concatenate(bucket), np.concatenate(owner), np.diff(words.first)


def bucket_counts(texts: DataFrame, longest: int = 1, buckets: int = BUCKETS, text_col: str = "text") -> np.ndarray:
    """How often each bucket occurs in all texts; tasks add up before the shuffle, ``buckets`` rows come back."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for part in slices(batches, text_col):
            total += np.bincount(features(part.column(text_col), longest, buckets)[0], minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["bucket", "n"])

    parts = bounded(texts.select(text_col)).mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row a bucket at most
        out[row.bucket] = row.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Scaled log ratio of each bucket's smoothed shares in target and source, rounded down."""
    ratio = (target + 1.0) * float(source.sum() + len(source)) / ((source + 1.0) * float(target.sum() + len(target)))
    return np.floor(SCALE * np.log(ratio)).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, longest: int = 1, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``n_features`` and ``weight``, the mean gain rounded down (0 without features).

    A null text has no words. Columns of these names are replaced, all others stay.
    """
    docs = bounded(docs.drop("n_words", "n_features", "weight"))
    names = ["n_words", "n_features", "weight"]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.LongType()) for n in names)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            bucket, text, n_words = features(part.column(text_col), longest, len(gain))
            n = np.bincount(text, minlength=part.num_rows)
            # sums of whole numbers, exact in doubles up to 2 ** 53
            total = np.bincount(text, weights=gain[bucket], minlength=part.num_rows).astype(np.int64)
            added = [n_words, n, total // np.maximum(n, 1)]
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x, pa.int64()) for x in added)],
                                             [*part.schema.names, *names])

    return docs.mapInArrow(run, schema)


def perturb(weighed: DataFrame, seed: int, id_col: str = "doc_id") -> DataFrame:
    """Adds ``score``: the weight plus a Gumbel number that the seed and the id alone decide."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return weighed.withColumn("score", F.col("weight") + gumbel)


def draw(scored: DataFrame, percent: int, eligible=None, id_col: str = "doc_id", ties: tuple[str, ...] = (),
         segments: int | None = None) -> DataFrame:
    """``scored`` with ``rank`` (1, 2, 3 ... for the drawn rows, else null), by falling ``score``.

    ``floor(percent * N / 100)`` of the N ``eligible`` rows are drawn (a condition; null
    counts as false, all rows without one). Equal scores go to the smaller id, a null id
    last, then to the smaller ``ties`` (whole numbers); rows equal in all of these, and
    repeated rows, in an order fixed when the runs are written. Every row comes back once; a column ``rank`` is replaced. ``segments`` is the
    number of tasks that sort (the session's shuffle partitions by default).
    """
    spark = scored.sparkSession
    ranges = min(segments or int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_SEGMENTS)
    scored = scored.drop("rank")
    names = scored.columns
    taken = F.coalesce(eligible, F.lit(False)) if eligible is not None else F.lit(True)
    keys = {"_k0": -F.col("score").cast("long"), "_k1": F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)),
            **{f"_t{n}": F.coalesce(F.col(c).cast("long"), F.lit(LAST_ID)) for n, c in enumerate(ties)},
            "_k2": F.monotonically_increasing_id()}
    order = list(keys)
    runs = materialize(scored.withColumns({"_in": taken, **keys}).sortWithinPartitions(*order), "runs")
    total = runs.where("_in").count()
    wanted = percent * total // 100
    splitters = _splitters(runs.where("_in").select(*order), total, ranges)
    placed = runs.where("_in").mapInArrow(_segment(splitters, order), T.StructType([*runs.schema.fields, T.StructField("_seg", T.IntegerType())]))
    counts = np.zeros(len(splitters) + 1, np.int64)
    for row in placed.select("_seg").groupBy("_seg").count().collect():  # one row a segment
        counts[row["_seg"]] = row["count"]
    before = np.cumsum(counts) - counts
    held = max(int(np.searchsorted(before, wanted, "left")), 1)  # segments that begin before the last drawn row
    schema = T.StructType([*placed.schema.fields, T.StructField("rank", T.LongType())])
    ranked = (placed.where(F.col("_seg") < held).repartitionById(held, F.col("_seg"))
              .sortWithinPartitions("_seg", *order).mapInArrow(_number(before, wanted), schema))
    rest = placed.where(F.col("_seg") >= held).select(*names).unionByName(runs.where("NOT _in").select(*names))
    return ranked.select(*names, "rank").unionByName(rest.withColumn("rank", F.lit(None).cast("long")))


def _splitters(keys: DataFrame, total: int, ranges: int) -> list[tuple[int, ...]]:
    """Keys that cut all rows into about even segments, from every ``step``-th row of the sorted runs.

    At most ``SAMPLES`` rows a segment and one a run come to the driver.
    """
    step = max(1, total // (SAMPLES * ranges))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            yield batch.take(pa.array(np.arange(-seen % step, batch.num_rows, step), pa.int64()))
            seen += batch.num_rows

    samples = sorted(tuple(row) for row in keys.mapInArrow(run, keys.schema).collect())
    cuts = (len(samples) * k // ranges for k in range(1, ranges))
    return sorted({samples[at] for at in cuts if at < len(samples)})


def _segment(splitters: list[tuple[int, ...]], order: list[str]):
    first = np.array([s[0] for s in splitters], np.int64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in order]
            low, high = (np.searchsorted(first, keys[0], side).astype(np.int32) for side in ("left", "right"))
            for i in np.flatnonzero(low < high):  # the first key does not decide
                low[i] = bisect_left(splitters, tuple(int(k[i]) for k in keys), int(low[i]), int(high[i]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low)], [*batch.schema.names, "_seg"])

    return run


def _number(before: np.ndarray, wanted: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, seen = -1, 0
        for batch in batches:
            seg = batch.column(batch.schema.get_field_index("_seg")).to_numpy()
            starts = np.flatnonzero(np.diff(seg, prepend=-1))
            place = np.arange(len(seg)) - np.repeat(starts, np.diff(starts, append=len(seg)))
            if len(seg):
                place[:np.searchsorted(seg, current, "right")] += seen if seg[0] == current else 0
                current, seen = int(seg[-1]), int(place[-1]) + 1
            rank = before[seg] + place + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rank, pa.int64(), mask=rank > wanted)],
                                             [*batch.schema.names, "rank"])

    return run


def resample(docs: DataFrame, target: DataFrame, percent: int, seed: int, least_words: int, longest: int = 1,
             buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without their texts, with n_words, n_features, weight, score and rank.

    Draws ``percent`` of the documents with ``least_words`` words or more towards the texts
    of ``target``. An empty ``target`` leaves only the smoothing; empty ``docs`` stay empty.
    """
    gain = gains(bucket_counts(docs, longest, buckets, text_col), bucket_counts(target, longest, buckets, text_col))
    scored = perturb(weigh(docs, gain, longest, text_col).drop(text_col), seed, id_col)
    return draw(scored, percent, F.col("n_words") >= least_words, id_col, ("n_features",))
