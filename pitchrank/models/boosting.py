"""Regularised gradient boosting of regression trees, on histograms of second order.

All groups (pitch types) are fitted side by side. Inputs are binned once at exact
quantiles of their training values. A level of all trees under construction is one Spark
aggregate: gradient and weight sums per (group, node, input, bin), of which tasks pick the
split of each node; their number is bounded by depth, inputs and bins, not by rows. Sums
are taken over whole multiples of a fixed step, so they are exact and do not depend on
how rows are dealt: a second fit gives the same trees.

For squared error with weights w the gradient is ``w (prediction - target)`` and its
derivative w. With G and H their sums in a node, ``T`` the soft threshold by ``l1``, a leaf
is worth ``-T(G) / (H + l2)`` times the learning rate, and a split gains
``T(G_l)^2 / (H_l + l2) + T(G_r)^2 / (H_r + l2) - T(G)^2 / (H + l2)``. Rows that lack the
input go to the side where the gain is larger. Rows are sampled by a hash of their
content, columns once per tree.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pitchrank.operators.ranks import ordered_counts
from pitchrank.params import BoostParams
from pitchrank.session import materialize, remove_table, scratch_path

LEAST_GAIN = 1e-6       # smaller gains split nothing (fixed value of the method)
REWRITE = 16            # trees after which predictions are written down with the rows
CELLS = 100_000         # in one partition of the sums
EXACT = 50              # bits of a sum that doubles hold without rounding, with some to spare
_TABLE = "grp int, val boolean, y double, w double, id long, bins binary, margin double"
_CELLS = "grp int, node int, cell int, g double, h double"
_BEST = ("grp int, node int, g double, h double, gain double, missing_left boolean, input int, bin int, "
         "lg double, lh double, rg double, rh double")


@dataclass
class Tree:
    """Nodes in heap order, the children of node k at 2k + 1 and 2k + 2; ``feature`` -1 marks a leaf."""

    feature: np.ndarray
    bin: np.ndarray
    threshold: np.ndarray
    missing_left: np.ndarray
    leaf: np.ndarray
    gain: np.ndarray
    weight: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = (2 << depth) - 1
        return cls(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n), np.zeros(n, bool), np.zeros(n),
                   np.zeros(n), np.zeros(n))

    def walk(self, values: np.ndarray, limits: np.ndarray, missing: np.ndarray) -> np.ndarray:
        """Node each row ends in; ``values <= limits[node]`` goes left."""
        node = np.zeros(len(values), np.int64)
        line = np.arange(len(values))
        for _ in range(int(math.log2(len(self.feature) + 1)) - 1):
            f = self.feature[node]
            own = values[line, f]
            left = np.where(missing[line, f], self.missing_left[node], own <= limits[node])
            node = np.where(f < 0, node, 2 * node + 2 - left)
        return node

    def of_bins(self, bins: np.ndarray, missing: int) -> np.ndarray:
        """Node each row of bins ends in, by a table of the next node for each node and bin."""
        split, at, codes = self.feature >= 0, np.arange(len(self.feature))[:, None], np.arange(missing + 1)
        left = np.where(codes == missing, self.missing_left[:, None], codes <= self.bin[:, None])
        following = np.where(split[:, None], 2 * at + 2 - left, at).ravel()
        column, flat, row = np.maximum(self.feature, 0), bins.ravel(), np.arange(len(bins)) * bins.shape[1]
        node = np.zeros(len(bins), np.int64)
        first = 0
        while split[first:2 * first + 1].any():
            node = following[node * (missing + 1) + flat[row + column[node]]]
            first = 2 * first + 1
        return node


@dataclass
class Booster:
    """The trees of one group, its start value, and the validation loss after each tree."""

    inputs: list[str]
    base: float
    trees: list[Tree] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)
    best: int = 0

    def predict(self, values: np.ndarray) -> np.ndarray:
        """Predictions for rows of inputs in order; NaN is a missing value."""
        out = np.full(len(values), self.base)
        missing = np.isnan(values)
        for tree in self.trees:
            out += tree.leaf[tree.walk(values, tree.threshold, missing)]
        return out

    def importance(self) -> np.ndarray:
        """Mean gain of each input's splits as a share of the sum of these means; 0 if it has none."""
        gain, n = np.zeros(len(self.inputs)), np.zeros(len(self.inputs))
        for tree in self.trees:
            split = tree.feature >= 0
            np.add.at(gain, tree.feature[split], tree.gain[split])
            np.add.at(n, tree.feature[split], 1)
        mean = gain / np.maximum(n, 1)
        return mean / mean.sum() if mean.any() else mean


@dataclass
class _Fit:
    """A group while it is fitted."""

    name: str
    number: int
    params: BoostParams
    booster: Booster
    cuts: list[np.ndarray]
    step_g: float           # gradients, weights and losses are counted in these steps
    step_h: float
    step_loss: float
    validated: bool         # has validation rows
    pending: list[Tree] = field(default_factory=list)   # not in the written predictions yet
    tree: Tree | None = None
    drawn: np.ndarray | None = None

    def begin(self, round_: int) -> None:
        """Begin a tree: its columns are drawn from the seed, the group and the round."""
        n = len(self.booster.inputs)
        rng = np.random.default_rng([self.params.seed, round_, zlib.crc32(self.name.encode())])
        self.drawn = np.sort(rng.permutation(n)[:max(1, int(self.params.column_sample * n))])
        self.tree = Tree.empty(self.params.depth)

    def settle(self, loss: float | None) -> bool:
        """Take in the loss of the last tree; whether fitting is over, with the trees cut at the best round."""
        b = self.booster
        if loss is not None:
            b.losses.append(loss)
        over = len(b.trees) >= self.params.rounds
        if self.validated and b.losses:
            b.best, stopped = best_round(b.losses, self.params.patience)
            over = over or stopped
        elif over:
            b.best = len(b.trees) - 1
        if over:
            b.trees = b.trees[:b.best + 1]
        return over

    def split(self, found: dict) -> None:
        """Give a node its worth and split it as a row of ``_BEST`` says."""
        tree, node = self.tree, found["node"]
        tree.leaf[node], tree.weight[node] = _leaf(found["g"], found["h"], self.params), found["h"]
        if found["input"] < 0:
            return
        tree.feature[node] = self.drawn[found["input"]]
        cuts, b = self.cuts[tree.feature[node]], found["bin"]
        tree.bin[node], tree.threshold[node] = b, cuts[b] if b < len(cuts) else np.inf
        tree.missing_left[node], tree.gain[node] = found["missing_left"], found["gain"]
        for child, (cg, ch) in ((2 * node + 1, (found["lg"], found["lh"])), (2 * node + 2, (found["rg"], found["rh"]))):
            tree.leaf[child], tree.weight[child] = _leaf(cg, ch, self.params), ch


def _shrink(g: np.ndarray, p: BoostParams) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - p.l1, 0)


def _leaf(g: float, h: float, p: BoostParams) -> float:
    return float(-p.learning_rate * _shrink(g, p) / (h + p.l2)) if h > 0 else 0.0


def _best_split(cells: np.ndarray, p: BoostParams, step_g: float, step_h: float) -> tuple:
    """Sums of a node and where it gains most; ``cells`` is (2, drawn inputs, bins and the missing)."""
    all_g, all_h = cells[0, 0].sum() * step_g, cells[1, 0].sum() * step_h
    score = lambda g, h: _shrink(g, p) ** 2 / np.where(h > 0, h + p.l2, 1)
    best = (LEAST_GAIN, False, -1, 0, 0.0, 0.0, 0.0, 0.0)
    for missing_left in (False, True):
        # whole steps are summed, so that equal sums are equal to the last bit
        left = np.cumsum(cells[:, :, :-1], axis=2) + (cells[:, :, -1:] if missing_left else 0)
        lg, lh = left[0] * step_g, left[1] * step_h
        rg, rh = (cells[0].sum(1)[:, None] - left[0]) * step_g, (cells[1].sum(1)[:, None] - left[1]) * step_h
        fits = (lh > 0) & (rh > 0) & (lh >= p.min_child_weight) & (rh >= p.min_child_weight)
        gain = np.where(fits, score(lg, lh) + score(rg, rh) - score(all_g, all_h), -1.0)
        at = np.unravel_index(np.argmax(gain), gain.shape)
        if gain[at] > best[0]:
            best = (gain[at], missing_left, *at, lg[at], lh[at], rg[at], rh[at])
    return (all_g, all_h, *best)


def best_round(losses: list[float], patience: int) -> tuple[int, bool]:
    """Round with the lowest loss before ``patience`` rounds pass without a lower one,
    and whether the patience ran out."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            return best, True
    return best, False


def quantile_cuts(rows: DataFrame, group: str, inputs: list[str], bins: int) -> DataFrame:
    """(group, input number, cut): the values at which a multiple of 1 / ``bins`` of the group's rows is passed.

    At most ``bins - 1`` a group and input, exact and independent of partitions; the largest
    value is no cut, since all rows would lie on one side.
    """
    values = F.array(*[F.col(c).cast("double") for c in inputs])
    long = rows.select(F.col(group).alias("grp"), F.posexplode(values).alias("input", "cut"))
    counted = ordered_counts(long, ["grp", "input"], "cut")
    passed = F.floor((F.col("n_before") + F.col("n_at")) * bins / F.col("n_total")) > F.floor(F.col("n_before") * bins / F.col("n_total"))
    return counted.where(passed & (F.col("n_before") + F.col("n_at") < F.col("n_total"))).select("grp", "input", "cut")


def fit_boosters(rows: DataFrame, inputs: list[str], target: str, params: dict[str, BoostParams], weight: str | None = None,
                 group: str = "pitch_type", split: str = "split") -> dict[str, Booster]:
    """Fit one booster per group named in ``params``, stopping early on its validation rows.

    ``split`` marks training (``train``) and validation rows (``val``); others, and rows
    with no target or no weight above 0, take no part. Validation rows are not weighted.
    Null and NaN inputs are missing values. A group without training rows has no booster,
    one without validation rows gets all its rounds. Fitting stops when the loss has not
    fallen for ``patience`` rounds; the trees after the best round are dropped. The driver
    holds trees and splits of a few groups; their rows may be any number.
    """
    if not params:
        return {}
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    numbers = [F.col(c).cast("double") for c in inputs]
    used = materialize(rows.where(F.col(group).isin(list(params)) & F.col(split).isin("train", "val")).select(
        F.col(group).alias("grp"), (F.col(split) == "val").alias("val"), F.col(target).cast("double").alias("y"), w.alias("w"),
        F.array(*[F.when(~F.isnan(c), c) for c in numbers]).alias("x"),
    ).where("y IS NOT NULL AND NOT isnan(y) AND w > 0 AND NOT isnan(w)"), "boost")
    fits = _starts(used, inputs, params)
    if not fits:
        return {}
    bins = max(p.bins for p in params.values())
    active = list(fits)
    # the rounds are many small jobs whose sizes are known, which adaptive planning only delays
    spark = rows.sparkSession.newSession()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    table, path = _write(_binned(used, fits, bins), spark)
    for round_ in range(max(f.params.rounds for f in fits) + 1):
        for f in active:
            f.begin(round_)
        nodes, losses = _sums(table, active, 0, round_, bins)
        active = [f for f in active if not f.settle(losses.get(f.number) if round_ else None)]
        if not active:
            break
        for level in range(max(f.params.depth for f in active)):
            if level:
                nodes, _ = _sums(table, [f for f in active if level < f.params.depth], level, round_, bins)
            for f in active:
                for found in nodes.get(f.number, []):
                    f.split(found)
        for f in active:
            f.booster.trees.append(f.tree)
            f.pending.append(f.tree)
        if len(active[0].pending) >= REWRITE:
            old = path
            table, path = _write(_advanced(table, active, bins), spark)
            remove_table(spark, old)
            for f in active:
                f.pending = []
    remove_table(spark, path)
    return {f.name: f.booster for f in fits}


def _write(df: DataFrame, reader: SparkSession) -> tuple[DataFrame, str]:
    path = scratch_path(reader, "boost")
    df.write.parquet(path)
    return reader.read.schema(_TABLE).parquet(path), path


def _starts(used: DataFrame, inputs: list[str], params: dict[str, BoostParams]) -> list[_Fit]:
    """Start values and cuts of every group with training rows; sums in decimals, which are exact in any order."""
    train = ~F.col("val")
    exact = lambda c: F.sum(F.when(train, c.cast("decimal(38,12)"))).cast("double")
    sizes = used.groupBy("grp").agg(
        F.count_if(train).alias("n"), F.count_if("val").alias("n_val"), exact(F.col("w")).alias("w"),
        exact(F.col("w") * F.col("y")).alias("wy"), F.min("y").alias("low"), F.max("y").alias("high")).where("n > 0").collect()
    bins = max(p.bins for p in params.values())
    wide = used.where(train).select("grp", *[F.get("x", F.lit(i)).alias(c) for i, c in enumerate(inputs)])
    # at most bins - 1 values a group and input
    cuts = quantile_cuts(wide, "grp", inputs, bins).toArrow().to_pandas() if inputs else None
    fits = []
    for number, row in enumerate(sorted(sizes, key=lambda r: r["grp"])):
        base = row["wy"] / row["w"]
        spread = max(row["high"] - base, base - row["low"], 1e-300)
        own = cuts[cuts.grp == row["grp"]] if inputs else None
        fits.append(_Fit(
            row["grp"], number, params[row["grp"]], Booster(list(inputs), base),
            [np.sort(own.cut[own.input == i].to_numpy(float)) for i in range(len(inputs))],
            _step(2 * spread * row["w"]), _step(row["w"]), _step(4 * spread ** 2 * max(row["n_val"], 1)), row["n_val"] > 0))
    return fits


def _step(largest: float) -> float:
    """A power of two of which sums up to ``largest`` hold at most 2 ** EXACT."""
    return 2.0 ** (math.frexp(largest)[1] - EXACT)


def _binned(used: DataFrame, fits: list[_Fit], bins: int) -> DataFrame:
    """The table the rounds read: bins of two bytes an input, ``bins`` for a missing value."""
    number, cuts = {f.name: f.number for f in fits}, {f.number: f.cuts for f in fits}
    base = {f.number: f.booster.base for f in fits}
    numbered = used.where(F.col("grp").isin(list(number))).select(
        F.element_at(F.create_map(*[F.lit(v) for pair in number.items() for v in pair]), F.col("grp")).cast("int").alias("grp"),
        "val", "y", "w", F.xxhash64("grp", "val", "y", "w", "x").alias("id"), "x")
    n_inputs = len(fits[0].cuts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grp = batch.column(0).to_numpy()
            x = batch.column(5).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, n_inputs).astype(float)
            out = np.empty(x.shape, np.uint16)
            for g in np.unique(grp):
                own = np.flatnonzero(grp == g)
                for i, cut in enumerate(cuts[g]):
                    out[own, i] = np.searchsorted(cut, x[own, i], "left")
            out[np.isnan(x)] = bins
            start = np.array([base[g] for g in grp.tolist()], float)
            packed = pa.array([line.tobytes() for line in out], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], packed, pa.array(start)],
                                             ["grp", "val", "y", "w", "id", "bins", "margin"])

    return numbered.mapInArrow(run, _TABLE)


def _groups(batch: pa.RecordBatch, wanted: set[int], n_inputs: int):
    """(group, its rows, their bins) for the wanted groups of a batch of the table."""
    grp = batch.column(0).to_numpy()
    packed = batch.column(5).cast(pa.binary())
    _, offsets, data = packed.buffers()  # two bytes an input, end to end
    start = np.frombuffer(offsets, np.int32)[packed.offset] if n_inputs and batch.num_rows else 0
    bins = np.frombuffer(data or b"", np.uint16, n_inputs * batch.num_rows, start).reshape(batch.num_rows, n_inputs)
    for g in np.unique(grp).tolist():
        if g in wanted:
            own = np.flatnonzero(grp == g)
            yield g, own, bins[own]


def _advanced(table: DataFrame, fits: list[_Fit], bins: int) -> DataFrame:
    """The rows of ``fits`` with their pending trees added to the predictions."""
    pending = {f.number: f.pending for f in fits}
    n_inputs = len(fits[0].cuts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margin = batch.column(6).to_numpy().copy()
            for g, own, x in _groups(batch, set(pending), n_inputs):
                for tree in pending[g]:
                    margin[own] += tree.leaf[tree.of_bins(x, bins)]
            yield batch.set_column(6, "margin", pa.array(margin))

    return table.where(F.col("grp").isin(list(pending))).mapInArrow(run, _TABLE)


def _sampled(ids: np.ndarray, seed: int, round_: int, share: float) -> np.ndarray:
    """Which rows a tree sees: a hash of the row, the seed and the round."""
    if share >= 1:
        return np.ones(len(ids), bool)
    x = ids.astype(np.uint64) + np.uint64((seed * 1_000_003 + round_ + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(11)).astype(float) < share * 2.0 ** 53


def _sums(table: DataFrame, fits: list[_Fit], level: int, round_: int, bins: int):
    """Best splits of one level: {group: rows of ``_BEST``, one a node}, and validation losses before the tree.

    Every task adds up what it reads; one row per cell goes through the shuffle, and the cells of
    a node meet in a task, which picks the node's split. Only that reaches the driver.
    """
    jobs = {f.number: (f.pending, f.tree, f.drawn, f.step_g, f.step_h, f.step_loss, f.params.seed, f.params.subsample)
            for f in fits}
    if not jobs:
        return {}, {}
    n_inputs, first, width = len(fits[0].cuts), (1 << level) - 1, 1 << level
    n_cells = len(fits) * width * len(fits[0].drawn) * (bins + 1)
    n_parts = max(1, -(-n_cells // CELLS))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        losses: dict[int, np.ndarray] = {}
        for batch in batches:
            val, y, w, ids, margin = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3, 4, 6))
            for g, own, x in _groups(batch, set(jobs), n_inputs):
                pending, tree, drawn, step_g, step_h, step_loss, seed, share = jobs[g]
                rest = margin[own] - y[own]
                for old in pending:
                    rest += old.leaf[old.of_bins(x, bins)]
                held = val[own]
                if level == 0 and held.any():
                    losses[g] = losses.get(g, 0) + np.array([np.rint(rest[held] ** 2 / step_loss).sum(), held.sum()])
                node = tree.of_bins(x, bins) - first
                use = np.flatnonzero(~held & (node >= 0) & (node < width) & _sampled(ids[own], seed, round_, share))
                size = width * len(drawn) * (bins + 1)
                cell = ((node[use, None] * len(drawn) + np.arange(len(drawn))) * (bins + 1) + x[use][:, drawn]).ravel()
                weight = w[own][use]
                both = [np.bincount(cell, np.repeat(v, len(drawn)), size)
                        for v in (np.rint(weight * rest[use] / step_g), np.rint(weight / step_h))]
                total[g] = total.get(g, 0) + np.stack(both)
        for g, sums in total.items():
            cell = np.flatnonzero(sums[1])
            of_node = len(jobs[g][2]) * (bins + 1)
            yield _cells(g, first + cell // of_node, cell % of_node, *sums[:, cell])
        for g, loss in losses.items():
            yield _cells(g, np.array([-1]), np.array([0]), *loss[:, None])

    params = {f.number: f.params for f in fits}

    def best(cells: pa.Table) -> pa.Table:
        grp, node = cells.column("grp")[0].as_py(), cells.column("node")[0].as_py()
        cell, g, h = (cells.column(c).to_numpy() for c in ("cell", "g", "h"))
        if node < 0:
            row = (g[0], h[0], 0.0, False, -1, 0, 0.0, 0.0, 0.0, 0.0)
        else:
            _, _, drawn, step_g, step_h = jobs[grp][:5]
            dense = np.zeros((2, len(drawn) * (bins + 1)))
            dense[:, cell] = g, h
            row = _best_split(dense.reshape(2, len(drawn), bins + 1), params[grp], step_g, step_h)
        values = (grp, node, *(v.item() if isinstance(v, np.generic) else v for v in row))
        return pa.table({f.name: pa.array([v], to_arrow_type(f.dataType)) for f, v in zip(best_type, values, strict=True)})

    best_type = T.StructType.fromDDL(_BEST)
    found = (table.where(F.col("grp").isin(list(jobs))).mapInArrow(run, _CELLS).repartition(n_parts, "grp", "node")
             .groupBy("grp", "node", "cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
             .groupBy("grp", "node").applyInArrow(best, best_type).toArrow().to_pylist())  # a row a node
    nodes = {f.number: sorted((r for r in found if r["grp"] == f.number and r["node"] >= 0), key=lambda r: r["node"]) for f in fits}
    step = {f.number: f.step_loss for f in fits}
    return nodes, {r["grp"]: math.sqrt(r["g"] * step[r["grp"]] / r["h"]) for r in found if r["node"] < 0}


def _cells(grp: int, node: np.ndarray, cell: np.ndarray, g: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(cell), grp, np.int32)), pa.array(node.astype(np.int32)), pa.array(cell.astype(np.int32)),
         pa.array(g), pa.array(h)], ["grp", "node", "cell", "g", "h"])


def tree_rows(name: str, booster: Booster) -> Iterator[tuple]:
    """Rows of ``TREES``, one per node that is reached."""
    for number, t in enumerate(booster.trees):
        reached = [0]
        for k in reached:
            yield (name, number, k, int(t.feature[k]), int(t.bin[k]), float(t.threshold[k]), bool(t.missing_left[k]),
                   float(t.leaf[k]), float(t.gain[k]), float(t.weight[k]), len(t.feature))
            if t.feature[k] >= 0:
                reached += [2 * k + 1, 2 * k + 2]


TREES = ("pitch_type string, tree int, node int, feature int, bin int, threshold double, missing_left boolean, "
         "leaf double, gain double, weight double, size int")


def from_rows(inputs: list[str], base: float, best: int, rows: Iterable) -> Booster:
    """The booster whose ``tree_rows`` these are, in any order."""
    trees: dict[int, Tree] = {}
    for r in rows:
        depth = (r["size"] + 1).bit_length() - 2
        tree = trees.setdefault(r["tree"], Tree.empty(depth))
        for name in ("feature", "bin", "threshold", "missing_left", "leaf", "gain", "weight"):
            getattr(tree, name)[r["node"]] = r[name]
    return Booster(inputs, base, [trees[k] for k in sorted(trees)], [], best)


def with_predictions(df: DataFrame, boosters: dict[str, Booster], out: str, group: str = "pitch_type") -> DataFrame:
    """``df`` with the prediction of each row's own booster, null for a group without one.

    Only the group and the inputs go to Python, in Arrow batches; absent columns and nulls
    are missing values. The trees travel with the plan.
    """
    if not boosters:
        return df.withColumn(out, F.lit(None).cast("double"))
    inputs = next(iter(boosters.values())).inputs

    @F.pandas_udf("double")
    def predict(kind: pd.Series, *values: pd.Series) -> pd.Series:
        x = np.column_stack([v.to_numpy(float) for v in values]) if values else np.zeros((len(kind), 0))
        found = np.full(len(kind), np.nan)
        for name, booster in boosters.items():
            own = np.flatnonzero(kind.to_numpy() == name)
            if len(own):
                found[own] = booster.predict(x[own])
        return pd.Series(found)

    values = [F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double") for c in inputs]
    return df.withColumn(out, F.nanvl(predict(F.col(group), *values), F.lit(None).cast("double")))
