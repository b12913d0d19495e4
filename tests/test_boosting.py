"""Boosting against a plain version that looks at every row for every candidate split."""

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchrank.models import boosting as B
from pitchrank.params import BoostParams

FEW = BoostParams(rounds=6, depth=3, learning_rate=0.3, min_child_weight=15, l1=0.2, l2=2.0, subsample=1.0, column_sample=1.0)
NAMES = ["a", "b", "c", "d"]
SCHEMA = "pitch_type string, split string, y double, w double, a double, b double, c double, d double"


def data(seed, n, kind="a", noise=0.1):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        x = np.round(rng.normal(size=4), 2)
        x[2] = rng.integers(0, 3)
        y = 2 * x[0] + math.sin(3 * x[1]) + noise * rng.normal() + (1.5 if i % 9 == 0 else 0)
        values = [float(v) for v in x]
        if i % 9 == 0:
            values[3] = None
        out.append((kind, "val" if i % 5 == 0 else "train", float(y), float(rng.integers(1, 30)), *values))
    return out


def brute(rows, p, bins=256):
    """Trees as nested tuples and the loss after each, by definition."""
    train = [r for r in rows if r[1] == "train"]
    held = [r for r in rows if r[1] == "val"]
    base = sum(r[2] * r[3] for r in train) / sum(r[3] for r in train)
    cuts = {}
    for f in range(4):
        values = sorted(r[4 + f] for r in train if r[4 + f] is not None)
        n = len(values)
        cuts[f] = [v for v in sorted(set(values)) if (k := sum(x <= v for x in values)) < n
                   and k * bins // n > sum(x < v for x in values) * bins // n] + [math.inf]
    shrink = lambda g: math.copysign(max(abs(g) - p.l1, 0), g)
    score = lambda g, h: shrink(g) ** 2 / (h + p.l2)

    def grow(own, predicted, depth):
        g = sum(r[3] * (m - r[2]) for r, m in zip(own, predicted))
        h = sum(r[3] for r in own)
        best = (1e-6, None)
        if depth:
            for late in (False, True):
                for f in range(4):
                    for cut in cuts[f]:
                        side = [late if r[4 + f] is None else r[4 + f] <= cut for r in own]
                        hl = sum(r[3] for r, s in zip(own, side) if s)
                        gl = sum(r[3] * (m - r[2]) for r, m, s in zip(own, predicted, side) if s)
                        if min(hl, h - hl) >= p.min_child_weight and min(hl, h - hl) > 0:
                            gain = score(gl, hl) + score(g - gl, h - hl) - score(g, h)
                            if gain > best[0] + 1e-9:
                                best = (gain, (f, cut, late, side))
        if best[1] is None:
            return -p.learning_rate * shrink(g) / (h + p.l2)
        f, cut, late, side = best[1]
        part = lambda want: grow([r for r, s in zip(own, side) if s is want],
                                 [m for m, s in zip(predicted, side) if s is want], depth - 1)
        return (f, cut, late, part(True), part(False))

    def value(tree, r):
        while isinstance(tree, tuple):
            x = r[4 + tree[0]]
            tree = tree[3] if (tree[2] if x is None else x <= tree[1]) else tree[4]
        return tree

    trees, losses, at = [], [], {id(r): base for r in rows}
    for _ in range(p.rounds):
        trees.append(grow(train, [at[id(r)] for r in train], p.depth))
        for r in rows:
            at[id(r)] += value(trees[-1], r)
        losses.append(math.sqrt(sum((at[id(r)] - r[2]) ** 2 for r in held) / len(held)))
    return base, trees, losses


def nested(tree, node=0):
    if tree.feature[node] < 0:
        return tree.leaf[node]
    return (int(tree.feature[node]), float(tree.threshold[node]), bool(tree.missing_left[node]),
            nested(tree, 2 * node + 1), nested(tree, 2 * node + 2))


def same(a, b):
    if not isinstance(a, tuple):
        return not isinstance(b, tuple) and a == pytest.approx(b, rel=1e-6, abs=1e-9)
    return isinstance(b, tuple) and a[:3] == b[:3] and same(a[3], b[3]) and same(a[4], b[4])


def fit(spark, rows, params, weight="w", parts=3):
    return B.fit_boosters(spark.createDataFrame(rows, SCHEMA).repartition(parts), NAMES, "y", params, weight)


def test_equals_brute_force(spark):
    rows, other = data(1, 240), data(2, 90, "b")
    got = fit(spark, rows + other, {"a": FEW, "b": replace(FEW, depth=2, rounds=3, l1=0.0), "absent": FEW})
    assert sorted(got) == ["a", "b"]
    for name, own, p in (("a", rows, FEW), ("b", other, replace(FEW, depth=2, rounds=3, l1=0.0))):
        base, trees, losses = brute(own, p)
        assert got[name].base == pytest.approx(base) and got[name].losses == pytest.approx(losses, rel=1e-6)
        assert all(same(nested(t), b) for t, b in zip(got[name].trees, trees, strict=True))
    frame = spark.createDataFrame(rows + other, SCHEMA)
    scored = B.with_predictions(frame.withColumn("k", F.lit(1)), got, "p").where("split = 'val'")
    for r in scored.groupBy("pitch_type").agg(F.sqrt(F.avg((F.col("p") - F.col("y")) ** 2)).alias("e")).collect():
        assert r.e == pytest.approx(got[r.pitch_type].losses[-1])


def test_bins_at_quantiles(spark):
    rows = data(3, 400)
    _, trees, _ = brute(rows, replace(FEW, rounds=2), bins=8)
    got = fit(spark, rows, {"a": replace(FEW, rounds=2, bins=8)})["a"]
    assert all(same(nested(t), b) for t, b in zip(got.trees, trees, strict=True))
    frame = spark.createDataFrame([(r[0], r[4]) for r in rows], "pitch_type string, a double")
    assert B.quantile_cuts(frame, "pitch_type", ["a"], 8).count() == 7


def test_same_trees_whatever_the_partitions(spark, monkeypatch):
    p = replace(FEW, rounds=12, subsample=0.7, column_sample=0.5)
    rows = data(4, 300) + data(5, 200, "b")
    first = fit(spark, rows, {"a": p, "b": p})
    monkeypatch.setattr(B, "REWRITE", 4)  # predictions are written down in between
    second = fit(spark, list(reversed(rows)), {"a": p, "b": p}, parts=7)
    for name in "ab":
        assert list(B.tree_rows(name, first[name])) == list(B.tree_rows(name, second[name]))
        assert first[name].losses == second[name].losses
    used = [set(t.feature[t.feature >= 0].tolist()) for t in first["a"].trees]
    assert all(len(u) <= 2 for u in used) and len(set.union(*used)) == 4  # two of four columns a tree


def test_stops_at_the_best_round_and_beats_the_mean(spark):
    p = replace(FEW, rounds=60, learning_rate=0.5, patience=5, depth=3)
    rows = data(6, 400, noise=1.5)
    got = fit(spark, rows, {"a": p})["a"]
    assert len(got.losses) < 60 and len(got.trees) == got.best + 1 and got.losses[got.best] == min(got.losses)
    assert len(got.losses) == got.best + 6
    held = np.array([r[2] for r in rows if r[1] == "val"])
    assert got.losses[got.best] < math.sqrt(((held - got.base) ** 2).mean())


def test_regularisation(spark):
    rows = data(7, 200)
    leaves = {}
    for name, p in (("none", replace(FEW, l1=0, l2=0)), ("l2", replace(FEW, l1=0, l2=500.0)), ("l1", replace(FEW, l1=1e9))):
        booster = fit(spark, rows, {"a": replace(p, rounds=1)})["a"]
        leaves[name] = np.abs(booster.trees[0].leaf).max()
    assert leaves["l2"] < leaves["none"] / 2 and leaves["l1"] == 0
    heavy = fit(spark, rows, {"a": replace(FEW, rounds=1, min_child_weight=1e6)})["a"]
    assert (heavy.trees[0].feature < 0).all()


def test_odd_rows(spark):
    rows = data(8, 60) + [("a", "train", None, 1.0, 1.0, 1.0, 1.0, 1.0), ("a", "train", 1.0, None, *[1.0] * 4),
                          ("a", "train", 9.0, -1.0, *[1.0] * 4), ("a", None, 1.0, 1.0, *[1.0] * 4), (None, "train", 1.0, 1.0, *[1.0] * 4)]
    odd = fit(spark, rows, {"a": FEW})["a"]
    assert list(B.tree_rows("a", odd)) == list(B.tree_rows("a", fit(spark, data(8, 60), {"a": FEW})["a"]))
    # NaN is a missing value; a group without validation rows gets all its rounds, one without training rows no booster
    nan = [(*r[:7], float("nan") if r[7] is None else r[7]) for r in data(8, 60)]
    assert list(B.tree_rows("a", fit(spark, nan, {"a": FEW})["a"])) == list(B.tree_rows("a", odd))
    train = [(r[0], "train", *r[2:]) for r in data(8, 60)]
    assert len(fit(spark, train, {"a": FEW})["a"].trees) == FEW.rounds
    assert fit(spark, [(r[0], "val", *r[2:]) for r in train], {"a": FEW}) == {}
    alike = fit(spark, [("a", "train", 2.0, 1.0, *[1.0] * 4)] * 40, {"a": FEW})["a"]
    assert alike.base == 2.0 and all((t.feature < 0).all() and (t.leaf == 0).all() for t in alike.trees)


def test_rows_of_trees(spark):
    got = fit(spark, data(9, 150), {"a": FEW})["a"]
    table = spark.createDataFrame(list(B.tree_rows("a", got)), B.TREES)
    back = B.from_rows(got.inputs, got.base, got.best, table.collect())
    x = np.random.default_rng(1).normal(size=(50, 4))
    x[::7, 3] = np.nan
    assert (back.predict(x) == got.predict(x)).all()
    assert got.importance().sum() == pytest.approx(1) and got.importance()[0] == got.importance().max()


def test_only_splits_reach_the_driver_and_trees_walk_alike(spark, monkeypatch):
    kind, sizes = type(spark.range(1)), []
    take = kind.toArrow

    def counted(df):
        found = take(df)
        sizes.append(found.num_rows)
        return found

    monkeypatch.setattr(kind, "toArrow", counted)
    p = replace(FEW, rounds=2)
    booster = B.fit_boosters(spark.createDataFrame(data(3, 600), SCHEMA), NAMES, "y", {"a": p}, "w")["a"]
    assert len(sizes) > 3 and max(sizes[1:]) <= 1 << (p.depth - 1)  # cuts come first; then a row a node, and a loss
    bins = np.random.default_rng(1).integers(0, 257, (500, len(NAMES))).astype(np.uint16)
    for tree in booster.trees:
        assert (tree.of_bins(bins, 256) == tree.walk(bins, tree.bin, bins == 256)).all()
