import math
import random

import numpy as np
from pyspark.sql import functions as F

from pitchrank.llm import negatives as G


def whole(v):
    return [max(-G.LARGEST, min(G.LARGEST, math.floor(256 * x))) for x in v]


def brute(rows, every=5, positives=5, negatives=3, low=50, high=95):
    """All pairs, by the definition."""
    fit = [(i, whole(v), y) for i, v, y in rows if None not in (i, v, y) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v, y in fit:
        if i % every:
            continue
        score = sorted((-sum(a * b for a, b in zip(v, w)), j, z) for j, w, z in fit)
        for s, j, _ in [x for x in score if x[2] == y and x[1] != i][:positives]:
            hard = [(t, k) for t, k, z in score if z != y and low * -s <= 100 * -t <= high * -s][:negatives]
            out += [(i, j, n, k, -s, -t) for n, (t, k) in enumerate(hard, 1)]
    return sorted(out)


def vectors(seed, n, dims=20, labels=3, copies=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        v = [rng.gauss(0, 1) for _ in range(dims)]
        size = math.sqrt(sum(x * x for x in v))
        out.append((i, [float(np.float32(x / size)) for x in v], rng.randrange(labels)))
    return out + [(n + k, out[0][1], k % labels) for k in range(copies)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)


def mined(spark, rows, every=5, **how):
    return sorted(map(tuple, G.mine(frame(spark, rows), F.col("vec_id") % every == 0, **how).collect()))


ODD = [(9000, [float("nan")] * 20, 1), (9005, [float("inf")] + [0.0] * 19, 1), (9010, None, 1), (9015, [0.1] * 20, None),
       (None, [0.1] * 20, 1), (9020, [None] + [0.1] * 19, 2), (9025, [0.0] * 20, 1), (9030, [], 2), (9035, [0.3] * 7, 0),
       (9040, [1e30] * 20, 0), (9045, [-1e30] * 20, 1)]


def test_equals_brute_force_over_many_tiles_and_blocks(spark, monkeypatch):
    rows = vectors(1, 600, copies=60) + ODD + vectors(1, 30)
    rows += [(7, rows[3][1], 0), (10, rows[5][1], 1)]  # repeated ids of other vectors
    want = brute(rows)
    assert want and mined(spark, rows) == want
    monkeypatch.setattr(G, "TILE", 37)
    monkeypatch.setattr(G, "ANCHORS", 50)
    assert mined(spark, rows) == want


def test_other_sizes_and_ranges(spark):
    rows = vectors(2, 150, dims=130, labels=2)
    assert mined(spark, rows, 3, positives=2, negatives=4, low=-100, high=100) == brute(rows, 3, 2, 4, -100, 100)


def test_intervals_hold_and_rule_out(spark):
    rng = np.random.default_rng(4)
    raw = rng.normal(size=(500, 64))
    raw /= np.linalg.norm(raw, axis=1)[:, None]
    table = spark.createDataFrame([(i, raw[i].tolist(), 0) for i in range(500)], "vec_id long, embedding array<double>, label int")
    coded = G.encode(G.usable(table, F.lit(True), "vec_id", "embedding", "label"), 64).toArrow()
    rows = G.Coded.read(coded, 64, 256)
    middle, half = G.Rounded.of(rows, 64).bounds(np.arange(500), rows.length, rows)
    exact = rows.whole @ rows.whole.T
    assert (np.abs(exact - middle) <= half).all()
    off = ~np.eye(500, dtype=bool)
    assert np.abs(exact - middle)[off].mean() < 0.06 * 65536 and half.max() < 0.55 * 65536
    assert (middle + half < 0.35 * 65536)[off].mean() > 0.3


def test_empty_and_clashing_columns(spark):
    rows = vectors(3, 60)
    assert mined(spark, []) == [] == mined(spark, rows[1:5], 50) == mined(spark, ODD[:6])
    odd = frame(spark, rows).select("*", *(F.lit("old").alias(c) for c in ("row", "id", "anchor", "whole", "score", "rank")))
    assert sorted(map(tuple, G.mine(odd, F.col("vec_id") % 5 == 0).collect())) == brute(rows)
    assert G.mine(odd, F.lit(None).cast("boolean")).count() == 0
