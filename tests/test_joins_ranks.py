import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitchrank.operators.joins import lookup_join
from pitchrank.operators.ranks import average_ranks, median_of, rank_rows
from pitchrank.operators.zscore import add_zscores


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_large_lookup_gives_the_same_rows(spark, how):
    """Beyond the broadcast limit: a hot key with a third of the rows, null keys, unknown keys."""
    rows = [(1, "a", 0)] * 400 + [(k, "b", k) for k in range(2, 600)] + [(None, "a", 1)] * 200 + [(7, None, 2)]
    df = spark.createDataFrame(rows, "k int, s string, v int")
    lookup = (df.where("k % 5 <> 0").dropna(subset=["k", "s"]).groupBy("k", "s")
              .agg(F.count(F.lit(1)).alias("_rows"), F.max("v").alias("top")))
    small = lookup_join(df, lookup, ["k", "s"], "_rows", how)
    large = lookup_join(df, lookup, ["k", "s"], "_rows", how, limit=0)
    assert small.columns == large.columns
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))
    uncounted = lookup_join(df, lookup.drop("_rows"), ["k", "s"], None, how, limit=0)
    assert sorted(map(str, uncounted.collect())) == sorted(map(str, small.collect()))
    plain = df.join(lookup.drop("_rows"), ["k", "s"], how)
    assert small.count() == plain.count()


def sample(seed=3, n=3000):
    rng = np.random.default_rng(seed)
    # one group holds most rows, and one value a third of them
    g = rng.choice(["hot", "b", "c"], n, p=[0.8, 0.15, 0.05])
    x = np.where(rng.random(n) < 0.34, 0.5, np.round(rng.normal(size=n), 2))
    pdf = pd.DataFrame({"g": g, "x": x})
    pdf.loc[::50, "x"] = None
    return pdf


def test_average_ranks_and_medians(spark):
    pdf = sample()
    rows = [(r.g, None if pd.isna(r.x) else float(r.x)) for r in pdf.itertuples()]
    df = spark.createDataFrame(rows, "g string, x double")
    ranks = {(r.g, r.x): r.avg_rank for r in average_ranks(df, ["g"], "x").collect()}
    full = pdf.dropna()
    want = full.assign(r=full.groupby("g").x.rank(method="average"))
    assert len(ranks) == len(want.drop_duplicates(["g", "x"]))
    for r in want.itertuples():
        assert ranks[(r.g, r.x)] == r.r
    medians = {r.g: r.median for r in median_of(df, ["g"], "x").collect()}
    assert medians == pytest.approx(full.groupby("g").x.median().to_dict())


def test_ranks_of_rows(spark):
    """Every row comes back with its rank, though a third of them share a value that fills several ranges."""
    pdf = sample()
    rows = [(r.g, None if pd.isna(r.x) else float(r.x), i) for i, r in enumerate(pdf.itertuples())]
    rows += [("b", float("nan"), 9001), (None, 1.0, 9002), (None, 1.0, 9003), ("one", 4.0, 9004)]
    df = spark.createDataFrame(rows, "g string, x double, i long")
    out = rank_rows(df, ["g"], "x")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join" in line and "x#" in line]
    got = {r.i: r.avg_rank for r in out.collect()}
    assert len(got) == len(rows)
    want = pdf.groupby("g").x.rank(method="average")
    assert all(got[i] == (None if pd.isna(w) else w) for i, w in want.items())
    assert (got[9001], got[9004]) == (None, 1.0)
    few = spark.createDataFrame([("a", 2.0)] * 5000 + [("a", 1.0), ("a", 3.0)], "g string, x double").repartition(4)
    assert {(r.x, r.avg_rank) for r in rank_rows(few, ["g"], "x").collect()} == {(1.0, 1.0), (2.0, 2501.5), (3.0, 5002.0)}
    assert rank_rows(few.limit(0), ["g"], "x").count() == 0


def test_median_of_even_and_single(spark):
    df = spark.createDataFrame([("e", 1.0), ("e", 4.0), ("s", 7.0)], "g string, x double")
    assert {r.g: r.median for r in median_of(df, ["g"], "x").collect()} == {"e": 2.5, "s": 7.0}


def test_zscores(spark):
    rows = [("FF", 2021, 1.0, 0.1), ("FF", 2021, 3.0, 0.1), ("FF", 2021, None, None), ("FF", 2022, 5.0, 1.0),
            ("SL", 2021, 0.1, None), ("SL", 2021, 0.1, None), ("SL", 2021, 0.1, 2.0)]
    df = spark.createDataFrame(rows, "pitch_type string, season int, a double, b double")
    out = add_zscores(df, ["a", "b", "absent"])
    assert out.columns == [*df.columns, "z_a", "z_b"]
    got = {tuple(r[:4]): (r.z_a, r.z_b) for r in out.collect()}
    s = 2**-0.5
    assert got[("FF", 2021, 1.0, 0.1)] == pytest.approx((-s, 0.0))
    assert got[("FF", 2021, None, None)] == (None, 0.0)  # null with spread, null without
    assert got[("FF", 2022, 5.0, 1.0)] == (0.0, 0.0)
    assert got[("SL", 2021, 0.1, None)] == (0.0, 0.0)


def test_zscores_have_mean_0_and_deviation_1(spark):
    pdf = sample().dropna()
    df = spark.createDataFrame([(r.g, float(r.x)) for r in pdf.itertuples()], "g string, x double")
    for r in add_zscores(df, ["x"], ["g"]).groupBy("g").agg(
            F.avg("z_x").alias("m"), F.stddev_samp("z_x").alias("s")).collect():
        assert (r.m, r.s) == pytest.approx((0.0, 1.0), abs=1e-9)
