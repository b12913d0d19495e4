import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitchrank.functions.codes import round_even
from pitchrank.operators import boards as B
from pitchrank.operators import validate as V
from pitchrank.operators.scale import apply_scaler, fit_scaler
from pitchrank.params import Settings


def scored(spark, rows):
    return spark.createDataFrame(rows, (
        "player_name string, pitcher long, season int, pitch_type string, pitch_group string, "
        "n_pitches long, score double"))


ROWS = [
    ("A", 1, 2025, "FF", "fastball", 60, 101.25), ("A", 1, 2026, "FF", "fastball", 50, 99.95),
    ("B", 2, 2026, "FF", "fastball", 90, 99.95), ("B", 2, 2026, "SL", "breaking", 49, 130.0),
    ("C", 3, 2026, "SL", "breaking", 70, 110.04), ("C", 3, 2026, "FO", "offspeed", 80, None),
]


def test_published_scores_come_out(spark):
    """Raw predictions and the scores they were published with."""
    raw = [(-0.0057084034, 55.9), (-0.00755579616, 88.9), (-0.00813718503, 99.2), (-0.00873431343, 109.9)]
    df = spark.createDataFrame([("SV", r, want) for r, want in raw], "pitch_type string, raw double, want double")
    scaler = spark.createDataFrame(
        [("SV", -0.008180186152458191, 0.0005606296472251415, 100.0, 10.0)],
        "pitch_type string, mean_raw double, std_raw double, center double, scale double")
    for r in apply_scaler(df, scaler, "raw").select(round_even(F.col("score"), 1).alias("s"), "want").collect():
        assert r.s == r.want


def test_scaler_centres_its_training_rows(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([("FF", float(v)) for v in rng.normal(size=300)] + [("KC", 1.0), ("FO", 2.0)],
                               "pitch_type string, raw double")
    out = apply_scaler(df, fit_scaler(df.where("pitch_type <> 'FO'"), "raw"), "raw")
    r = out.where("pitch_type = 'FF'").agg(F.avg("score"), F.stddev_pop("score")).first()
    assert tuple(r) == pytest.approx((100.0, 10.0))
    assert out.where("pitch_type <> 'FF' AND score IS NOT NULL").count() == 0  # no spread, no scaler
    best = out.orderBy("raw").first()
    assert best.score > 100


def test_half_even(spark):
    df = spark.createDataFrame([(0.25,), (0.35,), (2.5,), (-0.25,), (None,)], "x double")
    assert [r[0] for r in df.select(round_even(F.col("x"), 1)).collect()] == [0.2, 0.4, 2.5, -0.2, None]


def test_leaderboards(spark):
    df = scored(spark, ROWS)
    board = [(r.pitcher, r.score) for r in B.leaderboard(B.most_recent(df)).collect()]
    assert board == [(3, 110.0), (1, 100.0), (2, 100.0)]  # half-even, ties by pitcher
    assert [r.pitcher for r in B.leaderboard(df, group="fastball", pitch_type="SL").collect()] == [3]
    assert [r.pitch_type for r in B.leaderboard(df, min_pitches=1, group="breaking").collect()] == ["SL", "SL"]
    assert B.leaderboard(df).columns == ["player_name", "pitcher", "season", "pitch_type", "pitch_group", "n_pitches", "score"]
    by_type = [(r.pitch_type, r.pitcher) for r in B.leaderboards_by(B.most_recent(df), "pitch_type").collect()]
    assert by_type == [("FF", 1), ("FF", 2), ("SL", 3)]
    assert B.top(B.leaderboard(df), 1).count() == 1


def test_career(spark):
    rows = ROWS + [("A", 1, 2024, "FF", "fastball", 100, None)]
    got = {(r.pitcher, r.pitch_type): (r.score_career, r.total_pitches) for r in B.career(scored(spark, rows)).collect()}
    assert got[(1, "FF")] == (100.7, 210)  # the unscored season counts pitches only
    assert (3, "FO") not in got
    order = [r.score_career for r in B.career(scored(spark, rows)).collect()]
    assert order == sorted(order, reverse=True)


def test_rank_correlations_match_pandas(spark):
    rng = np.random.default_rng(4)
    n = 400
    pdf = pd.DataFrame({
        "pitch_type": rng.choice(["FF", "SL", "KC"], n, p=[0.7, 0.28, 0.02]),
        "score": np.round(rng.normal(100, 10, n), 0),
        "whiff_rate": np.where(rng.random(n) < 0.4, 0.0, np.round(rng.random(n), 2)),
        "csw_rate": np.round(rng.random(n), 2)})
    pdf.loc[::17, "score"] = np.nan
    pdf.loc[::13, "whiff_rate"] = np.nan
    pdf.loc[len(pdf)] = ["FO", np.nan, 0.1, 0.1]
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in pdf.itertuples(index=False)]
    df = spark.createDataFrame(rows, "pitch_type string, score double, whiff_rate double, csw_rate double")
    out = V.rank_correlations(df).collect()
    assert [r.pitch_type for r in out] == sorted(pdf.pitch_type.unique())
    for r in out:
        g = pdf[pdf.pitch_type == r.pitch_type]
        assert r.n == g.score.notna().sum()
        for mine, rate in ((r.r_whiff, "whiff_rate"), (r.r_csw, "csw_rate")):
            both = g[["score", rate]].dropna()
            if len(both) < 15:
                assert mine is None
            else:
                assert mine == pytest.approx(both.score.rank().corr(both[rate].rank()), abs=5.1e-4)
        assert r.low == (r.r_whiff is not None and r.r_whiff < 0.35)


def test_correlation_without_spread_is_null(spark):
    df = spark.createDataFrame([("FF", float(i), 0.5, None) for i in range(20)],
                               "pitch_type string, score double, whiff_rate double, csw_rate double")
    r = V.rank_correlations(df, Settings()).first()
    assert (r.n, r.r_whiff, r.r_csw, r.low) == (20, None, None, False)
    m = V.fit_metrics(df, "score", "whiff_rate").first()
    assert m.n == 20 and m["corr"] is None


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(100, 10, 500)
    df = scored(spark, [("A", 1, 2026, "FF", "fastball", 9, float(v)) for v in x]
                + [("A", 1, 2026, "SL", "breaking", 9, 7.0), ("A", 1, 2026, "FO", "offspeed", 9, None)])
    out = V.score_histogram(df).orderBy("pitch_type", "bin").collect()
    assert len(out) == 80
    counts, edges = np.histogram(x, bins=40)
    assert [r.n for r in out[:40]] == list(counts)
    assert [r.bin_low for r in out[:40]] == pytest.approx(list(edges[:-1]))
    assert [r.n for r in out[40:]] == list(np.histogram([7.0], bins=40)[0])
    assert V.score_histogram(df, group="breaking").count() == 40
