from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchrank import params as P
from pitchrank.models import training as M
from pitchrank.models.boosting import best_round, tree_rows
from pitchrank.models.scoring import score_profiles
from pitchrank.params import BoostParams, Settings

QUICK = BoostParams(rounds=14, depth=2, learning_rate=0.3, min_child_weight=50, l1=0.01, l2=2.0, patience=3)
FAST = Settings(standard_boost=QUICK, small_boost=QUICK)


@pytest.fixture(scope="module")
def profiles(spark):
    rng = np.random.default_rng(8)
    rows = []
    for kind, group, n in (("FF", "fastball", 90), ("SL", "breaking", 60), ("KC", "breaking", 12), ("FO", "offspeed", 30)):
        for i in range(n):
            values = {c: float(rng.normal()) for c in P.MODEL_INPUTS if c != "p_throws_enc"}
            if i % 7 == 0:
                values.update({c: None for c in P.NULLABLE_INPUTS})
            if i == 5:
                values["vaa"] = None
            label = 0.01 * values["release_speed"] + 0.002 * float(rng.normal())
            rows.append((i, 2023 + i % 3, kind, group, i % 2, f"P{i}", 50 + i, label,
                         *[values[c] for c in P.MODEL_INPUTS if c != "p_throws_enc"]))
    names = ", ".join(f"{c} double" for c in P.MODEL_INPUTS if c != "p_throws_enc")
    return spark.createDataFrame(rows, (
        "pitcher long, season int, pitch_type string, pitch_group string, p_throws_enc int, "
        f"player_name string, n_pitches long, lw_run_value double, {names}")).cache()


@pytest.fixture(scope="module")
def models(profiles):
    return M.train_models(profiles, settings=FAST)


def test_best_round():
    assert best_round([5, 4, 3, 4, 4, 4, 1], 3) == (2, True)
    assert best_round([5, 4, 3, 4, 4, 1], 4) == (5, False)
    assert best_round([1, 2, 3], 2) == (0, True)
    assert best_round([1], 30) == (0, False)


def test_split(profiles, spark):
    got = {(r.season, r.split) for r in M.time_split(profiles, 2024).select("season", "split").collect()}
    assert got == {(2023, "train"), (2024, "val"), (2025, None)}
    with pytest.raises(ValueError):
        M.time_split(spark.range(3), 2024)
    dated = spark.sql("SELECT DATE '2024-05-01' AS game_date")
    assert M.time_split(dated, 2024).first().split == "val"


def test_train_set_gates(profiles):
    rows = M.train_set(profiles, settings=FAST)
    sizes = {r.pitch_type: r.rows_complete for r in rows.select("pitch_type", "rows_complete").distinct().collect()}
    assert sizes == {"FF": 89, "SL": 59}  # KC is too thin, FO has no model; one row lacks an input
    assert rows.where(F.col("tunnel_dist_nearest").isNull()).count() > 0
    assert M.train_set(profiles, types=["SL"], settings=FAST).select("pitch_type").distinct().count() == 1
    # no earlier season to train on
    assert M.train_set(profiles, val_season=2023, settings=FAST).count() == 0


def test_models_learn_and_normalise(profiles, models):
    assert sorted(models) == ["FF", "SL"]
    for m in models.values():
        assert m.metrics["corr"] > 0.7 and m.metrics["rmse"] < 0.01
    scored = score_profiles(profiles, models)
    assert scored.count() == profiles.count()
    nulls = {r.pitch_type: r.n for r in scored.where("score IS NULL").groupBy("pitch_type").agg(F.count("*").alias("n")).collect()}
    assert nulls == {"KC": 12, "FO": 30}  # a missing input is filled
    r = scored.where("pitch_type = 'FF' AND season < 2025").agg(F.avg("score"), F.stddev_pop("score")).first()
    assert tuple(r) == pytest.approx((100.0, 10.0))
    # fewer runs score higher
    assert scored.where("pitch_type = 'FF'").agg(F.corr("score", "lw_run_value")).first()[0] < -0.7


def test_parameters_follow_the_size_of_a_type(profiles):
    """Both types are below the size of a small model; above it they get the standard parameters."""
    deep = Settings(standard_boost=QUICK, small_boost=replace(QUICK, depth=1, rounds=2), small_model_below=70)
    got = M.train_models(profiles, settings=deep)
    assert {k: len(m.model.trees[0].feature) for k, m in got.items()} == {"FF": 7, "SL": 3}
    assert len(got["SL"].model.trees) <= 2


def test_held_out_error_is_below_the_mean(profiles, models):
    for kind, m in models.items():
        rows = M.train_set(profiles, settings=FAST).where(F.col("pitch_type") == kind)
        plain = rows.where("split = 'val'").agg(F.sqrt(F.avg((F.col(P.LABEL) - m.model.base) ** 2))).first()[0]
        assert m.metrics["rmse"] < 0.6 * plain
        assert m.metrics["best_iteration"] == len(m.model.trees) - 1 < QUICK.rounds
        assert m.inputs == [c for c in P.MODEL_INPUTS if c in profiles.columns]


def test_second_fit_is_the_same(profiles, models):
    again = M.train_models(profiles.repartition(9), settings=FAST)
    for kind in models:
        assert list(tree_rows(kind, models[kind].model)) == list(tree_rows(kind, again[kind].model))


def test_save_and_load(spark, profiles, models, tmp_path):
    M.save_models(spark, models, str(tmp_path))
    loaded = M.load_models(spark, str(tmp_path))
    assert loaded["SL"].metrics == models["SL"].metrics and loaded["SL"].inputs == models["SL"].inputs
    a = score_profiles(profiles, models).select("pitcher", "pitch_type", "score")
    b = score_profiles(profiles, loaded).select("pitcher", "pitch_type", "score")
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_importance(spark, models):
    rows = M.feature_importance(spark, models, top=5).where("pitch_type = 'FF'").orderBy("place").collect()
    assert len(rows) == 5 and rows[0].feature == "release_speed"
    assert [r.importance for r in rows] == sorted((r.importance for r in rows), reverse=True)


def test_no_models(profiles):
    assert M.train_models(profiles, val_season=2023, settings=FAST) == {}  # no earlier season to learn from
    out = score_profiles(profiles, {})
    assert out.count() == profiles.count() and out.where("score IS NOT NULL").count() == 0
