"""What the physical plans must look like, whatever the data size."""

import uuid

import pytest
from pyspark.sql import functions as F

from pitchrank.operators import clean as C
from pitchrank.operators import features as X
from pitchrank.operators import profile as R
from pitchrank.operators.scale import apply_scaler, fit_scaler
from pitchrank.operators.tunnel import add_tunnel_features
from pitchrank.operators.validate import rank_correlations
from pitchrank.operators.zscore import add_zscores
from pitchrank.params import DEFAULTS, LABEL, PROFILE_KEYS, Settings
from pitchrank.session import materialize
from pitchrank.sources.tables import open_bucketed, write_bucketed


@pytest.fixture(scope="module")
def stored(spark):
    from pitchrank.fixtures import pitch_view

    return materialize(pitch_view(spark, "/root/testdata/sf0.001"), "raw")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pitches_are_cleaned_where_they_lie(stored):
    p = plan(C.clean(stored, Settings(min_pitches_per_season=20)))
    assert "BroadcastHashJoin" in p and "LeftSemi" in p
    assert "Exchange hashpartitioning" not in p and "Window" not in p


def test_the_speed_gap_moves_no_pitches(stored):
    p = plan(X.build_features(stored, DEFAULTS))
    assert "BroadcastHashJoin" in p and "Exchange hashpartitioning" not in p


def test_counts_read_only_what_they_need(stored):
    counts = C.screen(stored).groupBy("pitcher", F.year("game_date")).count()
    schema = plan(counts).split("ReadSchema: struct<")[1].split(">")[0]
    columns = {c.split(":")[0] for c in schema.split(",")}
    assert {"pitcher", "game_date", "pitch_type"} <= columns
    assert not columns & {"player_name", "vx0", "ax", "balls", "type", "release_pos_y", "p_throws"}


def test_profiles_are_partly_aggregated_before_the_shuffle(stored):
    feats = X.build_features(C.label_and_group(stored), DEFAULTS)
    p = plan(R.summarize(feats, DEFAULTS))
    assert p.count("Exchange hashpartitioning") == 1 and "partial_avg" in p
    assert "SortAggregate" not in p and "ObjectHashAggregate" not in p


def test_group_statistics_are_joined_not_windowed(stored):
    rows = materialize(R.summarize(X.build_features(C.label_and_group(stored)), DEFAULTS), "rows")
    z = plan(add_zscores(rows))
    assert "BroadcastHashJoin" in z and "Window" not in z and "Exchange hashpartitioning" not in z
    t = plan(add_tunnel_features(rows))
    assert t.count("Exchange hashpartitioning(pitcher") == 1 and "Join" not in t


def test_nothing_runs_in_python(spark, stored):
    profiles = R.profile(X.build_features(C.clean(stored, Settings(min_pitches_per_season=20)), DEFAULTS),
                         Settings(min_pitches_per_type=3))
    assert "Python" not in plan(profiles) and "Pandas" not in plan(profiles)
    assert set(PROFILE_KEYS) <= set(profiles.columns)


def jobs_of(spark, build):
    """How many Spark jobs building a result and reading all of it takes."""
    group = f"counted-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        build().write.format("noop").mode("overwrite").save()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_small_lookups_take_few_jobs(spark, stored):
    """The scaler is weighed and broadcast; the rows it is joined to are not counted for that."""
    rows = materialize(R.summarize(X.build_features(C.label_and_group(stored)), DEFAULTS), "rows")
    assert jobs_of(spark, lambda: apply_scaler(rows, fit_scaler(rows, LABEL), LABEL)) <= 4


def test_rank_correlations_take_few_jobs_and_no_join_on_a_value(spark, stored):
    rows = materialize(R.summarize(X.build_features(C.label_and_group(stored)), DEFAULTS).withColumn(
        "score", F.col(LABEL)), "rows")
    assert jobs_of(spark, lambda: rank_correlations(rows)) <= 12
    p = plan(rank_correlations(rows))
    assert not [line for line in p.splitlines() if "Join" in line and "value#" in line]


def test_pitches_stored_by_pitcher_are_not_shuffled(spark, stored, tmp_path):
    from pitchrank.plans import fused

    settings = Settings(min_pitches_per_season=20, min_pitches_per_type=3)
    path = str(tmp_path / "bucketed")
    table = write_bucketed(stored, "stored_by_pitcher", path, 4)
    assert "Exchange" not in plan(fused.pitcher_seasons(table, settings))
    rows, _ = fused.prepare(table, settings)
    assert "Exchange hashpartitioning" not in plan(R.summarize(rows, settings))
    assert "Exchange hashpartitioning" in plan(R.summarize(fused.prepare(stored, settings)[0], settings))
    spark.sql("DROP TABLE stored_by_pitcher")  # another session knows only the folder
    again = open_bucketed(spark, "stored_again", path, 4, stored.schema)
    assert "Exchange" not in plan(fused.pitcher_seasons(again, settings))
    assert sorted(map(str, again.collect())) == sorted(map(str, stored.select(*again.columns).collect()))
    spark.sql("DROP TABLE stored_again")


def test_a_pitcher_of_many_seasons_is_dealt_by_season(spark, stored, tmp_path):
    from pitchrank.plans import fused
    from pitchrank.sources.tables import buckets_for

    settings = Settings(min_pitches_per_season=20, min_pitches_per_type=3)
    dated = stored.withColumn("season", F.year("game_date"))
    one = dated.where(F.col("pitcher") == dated.agg(F.min("pitcher")).scalar())
    table = write_bucketed(dated, "stored_by_season", str(tmp_path / "bucketed"), 16, by=("pitcher", "season"))
    buckets = table.where(F.col("pitcher") == one.first()["pitcher"]).select("_metadata.file_path").distinct().count()
    assert 1 < buckets <= one.select("season").distinct().count()
    assert "Exchange" not in plan(fused.pitcher_seasons(table, settings, "season"))
    rows, _ = fused.prepare(table, settings, "season")
    assert "Exchange hashpartitioning" not in plan(R.summarize(rows, settings))
    got, want = fused.profiles_from_raw(table, settings, "season"), fused.profiles_from_raw(stored, settings)
    keys = ["pitcher", "season", "pitch_type", "n_pitches"]
    assert sorted(map(str, got.select(keys).collect())) == sorted(map(str, want.select(keys).collect()))
    spark.sql("DROP TABLE stored_by_season")
    assert buckets_for(spark.range(10)) == 8 and buckets_for(spark.range(2_250_001)) == 10


def test_a_delivery_is_dealt_over_more_partitions_the_larger_it_is(spark):
    from pitchrank.plans.queries import dealt_anew

    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "64k")
    try:
        parts = [dealt_anew(spark.range(n)).rdd.getNumPartitions() for n in (1000, 1_000_000)]
    finally:
        spark.conf.set(key, before)
    assert parts[0] <= 4 and parts[1] > 7
