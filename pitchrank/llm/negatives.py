"""Hard negatives of anchor vectors: near rows of another label, found exactly.

Every row is turned by one fixed rotation into ``CODES`` times as many dimensions and coded
by the signs there. The code, its length ``p`` within the space of the vectors, its alignment
``a`` with the unit vector, and the vector's length are stored with the row. An anchor's
turned unit vector is rounded to ``PLANES`` bits a dimension, so that its product ``g`` with
a code is a sum of popcounts. The unit row splits into a part along its code and a rest of
length ``sqrt(1 - a^2 / p^2)``, the anchor likewise with ``g``, and by Cauchy and Schwarz the
product of the rests is at most that of their lengths. This gives an interval that holds the
inner product for certain. Pairs whose interval cannot reach the best found so far, or misses
the wanted range, are left out; all others get their inner product in whole numbers.

Anchors come in blocks of a fixed number of rows, which travel to the tasks that read all
rows; each task keeps the best few per anchor, one record per some 100,000 pairs looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchrank.llm.textbytes import U
from pitchrank.session import materialize, scratch_path

CODES = 4              # code bits per dimension of the vectors
PLANES = 5             # bits an anchor's turned components are rounded to
SEED = 20240           # of the rotation
ANCHORS = 16_384       # rows in a block
TILE = 1024            # rows and anchors that are compared at once
LARGEST = 1 << 25      # whole components are cut to this size, so that sums fit 64 bits
NEVER = np.iinfo(np.int64).min
ROW = "row long, id long, label long, anchor boolean, whole binary, code binary, length double, along double, within double"
FOUND = "slot int, id long, score long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def usable(vectors: DataFrame, is_anchor: Column, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(row, id, label, anchor, whole) of the rows that take part, ``whole`` being floor(256 x) of each component."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    limit = F.lit(float(LARGEST))
    whole = F.transform(vector_col, lambda x: F.floor(F.greatest(-limit, F.least(limit, 256 * x.cast("double")))).cast("int"))
    there = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()
    return vectors.where(there & finite).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
        F.col(label_col).cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), whole.alias("whole"))


def rotation(dims: int) -> np.ndarray:
    """Turns vectors of ``dims`` components, as rows, into code space; its rows are orthonormal."""
    wide = max(64, -(-CODES * dims // 64) * 64)
    return np.linalg.qr(np.random.default_rng(SEED).normal(size=(wide, max(dims, 1))))[0].T


@dataclass
class Coded:
    """Rows with their codes."""

    row: np.ndarray
    id: np.ndarray
    label: np.ndarray
    whole: np.ndarray      # int64, one line per row
    code: np.ndarray       # uint64
    length: np.ndarray     # of the vector
    along: np.ndarray      # a / p^2
    within: np.ndarray     # 1 / p^2

    @classmethod
    def read(cls, batch: pa.RecordBatch | pa.Table, dims: int, wide: int) -> Coded:
        col = {n: batch.column(n) for n in batch.schema.names}
        packed = lambda n, kind, width: np.frombuffer(b"".join(col[n].to_pylist()), kind).reshape(-1, width)
        return cls(*(col[n].to_numpy() for n in ("row", "id", "label")),
                   packed("whole", np.int32, max(dims, 1)).astype(np.int64), packed("code", U, wide // 64),
                   *(col[n].to_numpy() for n in ("length", "along", "within")))


def encode(rows: DataFrame, dims: int) -> DataFrame:
    """The coded table; vectors shorter than ``dims`` count as filled up with zeros."""
    turn, width = rotation(dims), max(dims, 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            size = lists.value_lengths().to_numpy().astype(np.int64)
            whole = np.zeros((batch.num_rows, width), np.int64)
            line = np.repeat(np.arange(len(size)), size)
            whole[line, np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = lists.flatten().to_numpy()
            length = np.sqrt((whole.astype(float) ** 2).sum(1))
            turned = whole / np.maximum(length, 1)[:, None] @ turn
            signs = np.where(turned > 0, 1.0, -1.0) / np.sqrt(turn.shape[1])
            within = 1 / np.maximum(((signs @ turn.T) ** 2).sum(1), 1e-12)
            along = (turned * signs).sum(1) * within
            code = np.packbits(turned > 0, axis=1, bitorder="little")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array([x.tobytes() for x in whole.astype(np.int32)], pa.binary()),
                 pa.array([x.tobytes() for x in code], pa.binary()), *map(pa.array, (length, along, within))],
                [n.split()[0] for n in ROW.split(", ")])

    return rows.mapInArrow(run, ROW)


@dataclass
class Rounded:
    """Anchors turned and rounded, ready to be multiplied with codes by popcounts."""

    planes: np.ndarray     # PLANES x anchors x words
    low: np.ndarray        # value of a component of zero bits
    step: np.ndarray       # value of the lowest bit
    error: np.ndarray      # length of what rounding has left

    @classmethod
    def of(cls, anchors: Coded, dims: int) -> Rounded:
        turn = rotation(dims)
        turned = anchors.whole / np.maximum(anchors.length, 1)[:, None] @ turn
        low = turned.min(1)
        step = np.maximum((turned.max(1) - low) / ((1 << PLANES) - 1), 1e-12)
        level = np.clip(np.rint((turned - low[:, None]) / step[:, None]), 0, (1 << PLANES) - 1).astype(np.int64)
        error = np.sqrt(((turned - low[:, None] - step[:, None] * level) ** 2).sum(1))
        planes = [np.packbits(level >> k & 1, axis=1, bitorder="little").view(U) for k in range(PLANES)]
        return cls(np.stack(planes), low, step, error)

    def bounds(self, at: np.ndarray, length: np.ndarray, rows: Coded) -> tuple[np.ndarray, np.ndarray]:
        """Middle and half width of the interval of every (anchor, row) inner product."""
        wide = 64 * rows.code.shape[1]
        ones = np.zeros((len(at), len(rows.id)), np.int32)
        for k in range(PLANES):
            count = np.zeros(ones.shape, np.uint16)
            for w in range(rows.code.shape[1]):
                count += np.bitwise_count(self.planes[k, at, w, None] & rows.code[None, :, w])
            ones += count.astype(np.int32) << k
        total = sum(np.bitwise_count(self.planes[k, at]).sum(1).astype(np.int64) << k for k in range(PLANES))
        own = np.bitwise_count(rows.code).sum(1).astype(np.int64)
        # the code's components are 1 and -1 over sqrt(wide): twice the sum where it is 1, less the whole sum
        g = 2 * (self.step[at, None] * ones + self.low[at, None] * own) - (self.low[at] * wide + self.step[at] * total)[:, None]
        g /= np.sqrt(wide)
        error = self.error[at, None]
        rest = np.sqrt(np.clip(1 - rows.along ** 2 / rows.within, 0, 1))
        other = np.sqrt(np.clip(1 - np.maximum(np.abs(g) - error, 0) ** 2 * rows.within, 0, 1))
        scale = length[at, None] * rows.length
        half = scale * (np.abs(rows.along) * error + rest * other + 1e-9) + 1e-6  # and what doubles round off
        return scale * rows.along * g, half


class Best:
    """The best few (score, id) of each slot: higher scores first, then smaller ids."""

    def __init__(self, slots: int, most: int):
        self.most = most
        self.score = np.full((slots, most), NEVER, np.int64)
        self.id = np.zeros((slots, most), np.int64)

    def least(self) -> np.ndarray:
        """What a row must reach to be among the best of each slot."""
        return self.score[:, -1]

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        seen = np.unique(slot)
        old = np.repeat(seen, self.most)
        slot = np.concatenate([old, slot])
        score = np.concatenate([self.score[seen].ravel(), score])
        ids = np.concatenate([self.id[seen].ravel(), ids])
        order = np.lexsort((ids, -np.maximum(score, NEVER + 1), slot))
        slot, score, ids = slot[order], score[order], ids[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        top = place < self.most
        self.score[slot[top], place[top]] = score[top]
        self.id[slot[top], place[top]] = ids[top]

    def rows(self) -> pa.RecordBatch:
        slot, place = np.nonzero(self.score > NEVER)
        return pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(self.id[slot, place]),
                                           pa.array(self.score[slot, place])], ["slot", "id", "score"])


def _tiles(batches: Iterable[pa.RecordBatch], dims: int, wide: int) -> Iterator[Coded]:
    for batch in batches:
        for at in range(0, batch.num_rows, TILE):
            yield Coded.read(batch.slice(at, TILE), dims, wide)


def _against(rows: Coded, anchors: np.ndarray) -> Iterator[tuple[np.ndarray, Coded]]:
    """Some anchors at a time, with all rows of a tile."""
    for at in range(0, len(anchors), TILE):
        yield anchors[at:at + TILE], rows


def _pairings(rows: Coded, labels: np.ndarray, by_label: np.ndarray) -> Iterator[tuple[np.ndarray, Coded]]:
    """Some anchors at a time, with the rows of their label."""
    for label in np.unique(rows.label):
        lo, hi = np.searchsorted(labels[by_label], label, "left"), np.searchsorted(labels[by_label], label, "right")
        if lo < hi:
            own = rows.label == label
            yield from _against(Coded(**{k: v[own] for k, v in vars(rows).items()}), by_label[lo:hi])


def _scores(anchors: Coded, a: np.ndarray, rows: Coded, r: np.ndarray) -> np.ndarray:
    """Inner products of pairs in whole numbers."""
    out = np.empty(len(a), np.int64)
    for at in range(0, len(a), 1 << 15):
        part = slice(at, at + (1 << 15))
        out[part] = np.einsum("ij,ij->i", anchors.whole[a[part]], rows.whole[r[part]])
    return out


def _search(anchors: Coded, dims: int, most: int, ranges: tuple[np.ndarray, np.ndarray] | None):
    """Best rows of each anchor: of its label, or of others within ``ranges``, several for each anchor.

    ``ranges`` has the lowest and highest score for (anchor, positive); a slot is such a pair.
    """
    wide = rotation(dims).shape[1]
    n = len(anchors.id)
    each = 1 if ranges is None else ranges[0].shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rounded = Rounded.of(anchors, dims)
        best = Best(n * each, most)
        everyone = np.argsort(anchors.label, kind="stable")
        for rows in _tiles(batches, dims, wide):
            for at, part in _pairings(rows, anchors.label, everyone) if ranges is None else _against(rows, everyone):
                middle, half = rounded.bounds(at, anchors.length, part)
                least = best.least().reshape(n, each)[at]
                if ranges is None:
                    low, high = least[:, 0], None
                    wanted = part.id != anchors.id[at, None]
                else:
                    low, high = np.maximum(least, ranges[0][at]).min(1), ranges[1][at].max(1)
                    wanted = part.label != anchors.label[at, None]
                    wanted &= middle - half <= high[:, None]
                wanted &= middle + half >= low[:, None]
                a, r = np.nonzero(wanted)
                score = _scores(anchors, at[a], part, r)
                for k in range(each):
                    fits = score >= least[a, k]
                    if ranges is not None:
                        fits &= (score >= ranges[0][at[a], k]) & (score <= ranges[1][at[a], k])
                    if fits.any():
                        best.add(at[a[fits]] * each + k, score[fits], part.id[r[fits]])
        yield best.rows()

    return run


def _merged(found: DataFrame, most: int) -> DataFrame:
    """The best few of every slot over all tasks, with their place."""
    order = Window.partitionBy("slot").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
         id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Hard negatives (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become whole numbers, floor(256 x), cut to +-2^25; a shorter vector counts as
    filled up with zeros. A row with a null id, label, vector or component, or one that is not
    finite, takes no part. Scores are inner products; higher ones come first, equal ones by
    smaller id. Anchors are the rows for which ``is_anchor``, a condition on the input's
    columns, is true. An anchor's positives are its first ``positives`` rows of the same label
    and another id, its negatives for one of them the first ``negatives`` rows of another label
    with ``low * positive_score <= 100 * negative_score <= high * positive_score``. Repeated
    rows count as often as they occur, as anchors and as partners. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, is_anchor, id_col, vector_col, label_col)
    dims = rows.agg(F.max(F.size("whole"))).first()[0] or 0
    table = materialize(encode(rows, dims), "codes")
    n_anchors = table.where("anchor").count()
    wide = rotation(dims).shape[1]
    blocks = -(-n_anchors // (ANCHORS * 3 // 4)) if n_anchors > ANCHORS else 1
    path = scratch_path(spark, "negatives")
    spark.createDataFrame([], RESULT).write.parquet(path)
    for block in range(blocks if n_anchors else 0):
        # a bounded number of anchors, dealt by the row and not by an id that may repeat
        picked = table.where("anchor").where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).toArrow()
        if picked.num_rows:
            _mine_block(table, Coded.read(picked, dims, wide), dims, positives, negatives, low, high).write.mode("append").parquet(path)
    return spark.read.schema(RESULT).parquet(path)


def _mine_block(table: DataFrame, anchors: Coded, dims: int, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    spark = table.sparkSession
    near = _merged(table.mapInArrow(_search(anchors, dims, positives, None), FOUND), positives).toArrow()  # a few an anchor
    slot, place = near.column("slot").to_numpy(), near.column("place").to_numpy() - 1
    ids = np.zeros((len(anchors.id), positives), np.int64)
    score = np.full(ids.shape, NEVER, np.int64)
    ids[slot, place], score[slot, place] = near.column("id").to_numpy(), near.column("score").to_numpy()
    there = score > NEVER
    safe = np.where(there, score, 0)
    floor, ceiling = -(-low * safe // 100), high * safe // 100
    floor[~there], ceiling[~there] = 1, 0  # an empty range
    hits = _merged(table.mapInArrow(_search(anchors, dims, negatives, (floor, ceiling)), FOUND), negatives)
    pairs = spark.createDataFrame(pa.table({
        "slot": np.arange(ids.size, dtype=np.int32), "anchor_id": np.repeat(anchors.id, positives),
        "positive_id": ids.ravel(), "positive_score": safe.ravel()}))
    return hits.join(F.broadcast(pairs), "slot").select(
        "anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
