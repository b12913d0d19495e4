"""The registered queries: every operator on the shared tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import date
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchrank import params as P
from pitchrank.fixtures import pitch_view
from pitchrank.models.boosting import fit_boosters, with_predictions
from pitchrank.models.scoring import score_profiles
from pitchrank.models.training import (
    artifact_table, feature_importance, load_models, save_models, time_split, train_models, train_set,
)
from pitchrank.operators import boards as B
from pitchrank.operators import clean as C
from pitchrank.operators import features as X
from pitchrank.operators import profile as R
from pitchrank.operators import validate as V
from pitchrank.operators.scale import apply_scaler, fit_scaler
from pitchrank.operators.tunnel import add_tunnel_features, tunnel_summary
from pitchrank.operators.zscore import add_zscores
from pitchrank.params import Settings
from pitchrank.plans import jobs
from pitchrank.plans.fused import profiles_from_raw
from pitchrank.plans.incremental import refresh_profiles
from pitchrank.schema import keep_columns
from pitchrank.session import materialize, scratch_path, tune
from pitchrank.sources import calendar as K
from pitchrank.sources import landing as L
from pitchrank.sources import tables as S
from pitchrank.streaming.ingest import follow_landing, month_states

# The tables hold about 29 pitches per profile, so the default of 50 would leave
# little. Models are fitted with the method's rounds and patience.
SHARED = Settings(min_pitches_per_type=20, board_min_pitches=20)
ID = ["game_pk", "pitch_number"]
KEYS = list(P.PROFILE_KEYS)
_TODAY = date(2001, 1, 1)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register under the function's name, less a trailing underscore."""
    @wraps(fn)
    def tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(tune(spark), sf_dir)

    QUERIES[fn.__name__.rstrip("_")] = tuned
    return fn


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to six digits, with a hair added so that exact halves fall the same way everywhere."""
    doubles = {f.name: F.round(F.col(f.name) + F.lit(3e-9), 6) + F.lit(0.0)
               for f in df.schema if isinstance(f.dataType, T.DoubleType)}
    return df.withColumns(doubles) if doubles else df


def stored_view(spark, d) -> DataFrame:
    """The pitches moved twenty years on, into the seasons the calendar knows."""
    return pitch_view(spark, d).withColumn("game_date", F.add_months("game_date", 240))


def cleaned(spark, d) -> DataFrame:
    return C.clean(pitch_view(spark, d), SHARED)


def featured(spark, d) -> DataFrame:
    return X.build_features(cleaned(spark, d), SHARED)


def profiles(spark, d) -> DataFrame:
    return profiles_from_raw(pitch_view(spark, d), SHARED)


def scaled(spark, d) -> DataFrame:
    """Profiles scored with their own mean run value in place of a prediction."""
    rows = materialize(profiles(spark, d), "profiles")
    newest = rows.select(F.max("season")).scalar()
    scaler = fit_scaler(rows.where(F.col("season") < newest), P.LABEL, SHARED)
    return materialize(apply_scaler(rows, scaler, P.LABEL), "scored")


# --- sources and sinks ------------------------------------------------------

@query
def scan_seasons(spark, d):
    root = scratch_path(spark, "store")
    S.write_table(pitch_view(spark, d).withColumn("season", F.year("game_date")), root, partition_by=["season"])
    return tidy(S.load_seasons(spark, root, [1996, 1998], columns=[
        *ID, "pitcher", "season", "pitch_type", "release_speed"]))


@query
def scan_seasons_uneven(spark, d):
    """Two seasons, one of them stored without two of the columns."""
    root = scratch_path(spark, "store")
    rows = pitch_view(spark, d).withColumns({"season": F.year("game_date"), "month": F.month("game_date")})
    for season, lacking in ((1996, ["spin_axis", "description"]), (1998, [])):
        S.write_table(rows.where(F.col("season") == season).drop("season", *lacking), f"{root}/season={season}",
                      partition_by=["month"])
    return tidy(S.load_seasons(spark, root, [1996, 1998], columns=[
        *ID, "season", "month", "description", "spin_axis", "release_speed"]))


@query
def keep_columns_(spark, d):
    return tidy(keep_columns(pitch_view(spark, d).withColumn("not_wanted", F.lit(1))))


@query
def roundtrip_parquet(spark, d):
    path = scratch_path(spark, "copy")
    S.write_table(pitch_view(spark, d), path, codec="zstd")
    return tidy(S.read_table(spark, path))


@query
def union_seasons(spark, d):
    rows = pitch_view(spark, d).select(*ID, "game_date", "pitch_type", "description", "release_speed")
    old = rows.where(F.year("game_date") <= 1997)
    new = rows.where(F.year("game_date") > 1997).drop("description")
    return tidy(S.union_tables(old, new).drop("game_date"))


@query
def csv_to_parquet(spark, d):
    path = scratch_path(spark, "csv")
    rows = pitch_view(spark, d).select(*ID, "game_date", "pitcher", "pitch_type", "release_speed", "spin_axis")
    rows.write.option("header", True).csv(path)
    return tidy(S.read_csv_cached(spark, path, f"{path}.parquet", rows.schema))


@query
def season_calendar(spark, d):
    return K.in_season(stored_view(spark, d)).select(*ID, "game_date", "season")


@query
def month_ranges(spark, d):
    spans = pitch_view(spark, d).groupBy("pitcher").agg(
        F.min("game_date").alias("first"), F.max("game_date").alias("last"))
    return K.month_ranges(spans, F.col("first"), F.col("last")).drop("first", "last")


def _store_columns(df):
    return tidy(df.select(*ID, "game_date", "pitcher", "season", "month", "release_speed"))


@query
def ingest_season(spark, d):
    root = scratch_path(spark, "store")
    landing = stored_view(spark, d)
    L.ingest_season(spark, landing, root, 2018, today=date(2020, 1, 1))
    # complete by now: served from the store, the empty landing area is not looked at
    return _store_columns(L.ingest_season(spark, landing.limit(0), root, 2018, today=date(2020, 1, 1)))


@query
def ingest_season_text(spark, d):
    """Dates that land as text, every third of them unreadable."""
    day = F.when(F.col("game_pk") % 3 == 0, "soon").otherwise(F.col("game_date").cast("string"))
    landing = stored_view(spark, d).withColumn("game_date", day)
    return _store_columns(L.ingest_season(spark, landing, scratch_path(spark, "store"), 2018, today=date(2020, 1, 1)))


@query
def refresh_months(spark, d):
    root = scratch_path(spark, "store")
    landing = stored_view(spark, d)
    for today in (date(2019, 5, 20), date(2019, 8, 15)):
        out = L.refresh_months(spark, landing, root, 2019, today)
    return _store_columns(out)


def _full_store(spark, d) -> str:
    root = scratch_path(spark, "store")
    L.replace_months(spark, pitch_view(spark, d), root, _TODAY)
    return root


@query
def manifest(spark, d):
    return L.read_manifest(spark, _full_store(spark, d)).select("season", "month", "rows", "is_complete")


@query
def cache_summary(spark, d):
    """The summary, its sizes held against the lengths of the files themselves."""
    root = _full_store(spark, d)
    listed = L.cache_summary(L.read_manifest(spark, root))
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
             .load(root).select(F.regexp_extract("path", "season=[0-9]+/month=[0-9]+", 0).alias("file"), "length"))
    sizes = files.groupBy("file").agg(F.bround(F.sum("length") / F.lit(1e6), 1).alias("mb"))  # a row a month
    return listed.join(sizes, "file").select("file", "season", "month", "rows", "complete",
                                             (F.col("size_mb") == F.col("mb")).alias("size_agrees"))


@query
def pitcher_scan(spark, d):
    """One pitcher's pitches from a clustered store, and whether less than half of all rows left the files for it.

    The months of this table are short; the share falls as they grow.
    """
    root = scratch_path(spark, "store")
    L.replace_months(spark, pitch_view(spark, d), root, _TODAY, clustered=True, page_rows=64)
    stored = S.read_store(spark, root)
    one = stored.where("pitcher = 103").select(*ID, "pitcher", "pitch_type", "release_speed")
    read = S.rows_scanned(one)
    return tidy(one.withColumn("less_than_half", F.lit(read) * 2 < F.lit(stored.count())))


def dealt_anew(rows: DataFrame) -> DataFrame:
    """``rows`` in another order, over as many partitions as their size asks for."""
    return rows.hint("rebalance")


@query
def unchanged_months(spark, d):
    """All months delivered twice, the second time in other files and with the fastest pitches of 1997
    faster still: which months keep their fingerprint, and which their files."""
    root = scratch_path(spark, "store")
    rows = pitch_view(spark, d)
    L.replace_months(spark, rows, root, _TODAY)
    first = materialize(L.read_manifest(spark, root), "manifest").select(
        "season", "month", F.col("version").alias("_version"), F.col("fingerprint").alias("_fingerprint"))
    chosen = (F.year("game_date") == 1997) & (F.col("release_speed") > 103)
    faster = rows.withColumn("release_speed", F.when(chosen, F.col("release_speed") + 1).otherwise(F.col("release_speed")))
    L.replace_months(spark, dealt_anew(faster), root, _TODAY)
    return L.read_manifest(spark, root).join(first, ["season", "month"]).select(
        "season", "month", "rows", (F.col("fingerprint") == F.col("_fingerprint")).alias("same_rows"),
        (F.col("version") == F.col("_version")).alias("same_files"))


def _stream(spark, d):
    """Paths of a landing area, a store and checkpoints, and a function that lands a delivery."""
    landing, root, marks = (scratch_path(spark, n) for n in ("landing", "store", "marks"))
    rows = pitch_view(spark, d)

    def follow(today, **how):
        follow_landing(spark, landing, root, marks, today, schema=rows.schema, **how)

    def land(part, delivery):
        part.withColumn("delivery", F.lit(delivery)).write.mode("append").partitionBy("delivery").parquet(landing)

    return root, marks, rows, land, follow


_FIRST_HALF = "game_date < DATE '1998-06-01'"


@query
def stream_ingest(spark, d):
    root, _, rows, land, follow = _stream(spark, d)
    land(rows.where(_FIRST_HALF), 1)
    follow(date(2002, 1, 1))
    # the first half comes again, with the second
    land(rows, 2)
    follow(date(2002, 1, 1))
    return _store_columns(S.read_store(spark, root))


@query
def stream_close(spark, d):
    """Months of a first delivery close by its mark alone; the second one brings them again, too late."""
    root, marks, rows, land, follow = _stream(spark, d)
    land(rows.where(_FIRST_HALF), 1)
    follow(date(2002, 1, 1))
    follow(date(2002, 1, 1), finished=(1,))
    land(rows, 2)
    follow(date(2002, 1, 1))
    return month_states(spark, root, marks)


@query
def replace_visible(spark, d):
    """What readers see while the months of 1997 are replaced by twice as fast pitches: before the
    commit, after a write that failed, and after the commit."""
    root = scratch_path(spark, "store")
    rows = pitch_view(spark, d)
    L.replace_months(spark, rows, root, _TODAY)

    def seen(moment):
        stored = S.read_store(spark, root).groupBy("season").agg(
            F.count(F.lit(1)).alias("rows"), F.sum("release_speed").alias("speed"))
        return materialize(stored.select(F.lit(moment).alias("moment"), "season", "rows", "speed"), "seen")

    fast = rows.where(F.year("game_date") == 1997).withColumn("release_speed", F.col("release_speed") * 2)
    staged = L.stage_months(spark, fast, root)
    moments = [seen("written")]
    broken = F.when(F.month("game_date") == 11, F.raise_error(F.lit("broken off"))).otherwise(F.col("release_speed"))
    try:
        L.stage_months(spark, fast.withColumn("release_speed", broken.cast("double")), root, skip_same=False)
    except Exception as error:
        if "broken off" not in str(error):
            raise
        moments.append(seen("failed"))
    L.commit_months(spark, staged, F.lit(True))
    moments.append(seen("committed"))
    return tidy(S.union_tables(*moments))


@query
def leaderboard_csv(spark, d):
    path = scratch_path(spark, "board")
    S.save_board(B.leaderboard(B.most_recent(scaled(spark, d)), 20), path)
    return tidy(S.read_board(spark, path))


# --- projections ------------------------------------------------------------

@query
def normalize_codes(spark, d):
    return C.normalize_codes(pitch_view(spark, d)).select(*ID, "pitch_type")


@query
def season_of(spark, d):
    text = F.when(F.col("pitch_number") == 3, "not a date").otherwise(F.col("game_date").cast("string"))
    rows = C.parse_dates(pitch_view(spark, d).withColumn("game_date", text))
    return rows.select(*ID, F.year("game_date").alias("season"))


@query
def run_value(spark, d):
    rows = pitch_view(spark, d).drop("balls", "strikes")
    return tidy(C.drop_unlabelled(C.add_run_value(rows)).select(*ID, F.col(P.LABEL).alias("runs")))


@query
def count_leverage(spark, d):
    from pitchrank.functions.codes import count_weight

    return tidy(C.add_run_value(pitch_view(spark, d)).select(
        *ID, count_weight(F.col("balls"), F.col("strikes")).alias("weight"), P.LABEL))


@query
def clip_bounds(spark, d):
    rows = C.clip_columns(pitch_view(spark, d))
    return tidy(rows.select(*ID, *[c for c in P.CLIP_BOUNDS if c in rows.columns]))


@query
def encode_hand(spark, d):
    return C.encode_hand(pitch_view(spark, d)).select(*ID, "p_throws", "p_throws_enc")


@query
def pitch_group(spark, d):
    rows = C.add_pitch_group(pitch_view(spark, d))
    return C.drop_ungrouped(rows).select(*ID, "pitch_type", "pitch_group")


_PHYSICS = ["induced_vertical_break", "horz_break", "arm_side_break", "vaa", "haa", "speed_diff",
            "spin_efficiency", *P.TUNNEL_POSITIONS]


@query
def physics_features(spark, d):
    return tidy(featured(spark, d).select(*ID, "pitcher", "pitch_type", "p_throws_enc", *_PHYSICS))


@query
def spin_efficiency(spark, d):
    return tidy(X.add_spin_efficiency(cleaned(spark, d)).select(*ID, "spin_efficiency"))


@query
def tunnel_positions(spark, d):
    return tidy(X.add_tunnel_positions(cleaned(spark, d)).select(*ID, *P.TUNNEL_POSITIONS))


@query
def speed_diff(spark, d):
    return tidy(X.add_speed_diff(cleaned(spark, d)).select(*ID, "pitcher", "pitch_type", "speed_diff"))


# --- filters ----------------------------------------------------------------

@query
def required_columns(spark, d):
    return tidy(C.drop_incomplete(C.normalize_codes(pitch_view(spark, d))).select(
        *ID, "pitch_type", "release_spin_rate"))


@query
def velocity_floors(spark, d):
    return tidy(C.screen(pitch_view(spark, d)).select(*ID, "pitch_type", "release_speed"))


@query
def min_group_count(spark, d):
    rows = C.drop_rare_pitchers(C.screen(pitch_view(spark, d)), SHARED.min_pitches_per_season)
    return rows.select(*ID, "pitcher", F.year("game_date").alias("season"))


@query
def min_group_count_events(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select(
        "event_id", F.col("user_id").alias("pitcher"), F.col("ts").alias("game_date"))
    return C.drop_rare_pitchers(rows, 60).select("event_id", F.col("pitcher").alias("user_id"))


@query
def clean(spark, d):
    return tidy(cleaned(spark, d))


# --- aggregates -------------------------------------------------------------

@query
def clean_report(spark, d):
    return tidy(C.clean_report(pitch_view(spark, d), SHARED))


@query
def floor_drops(spark, d):
    return tidy(C.floor_drops(pitch_view(spark, d)))


@query
def unknown_groups(spark, d):
    groups = {k: v for k, v in P.PITCH_GROUPS.items() if k != "offspeed"}
    return C.unknown_groups(pitch_view(spark, d), Settings(pitch_groups=groups))


@query
def unknown_descriptions(spark, d):
    return C.unknown_descriptions(pitch_view(spark, d), settings=SHARED)


@query
def outcome_rates(spark, d):
    rows = R.with_season(cleaned(spark, d))
    return tidy(rows.groupBy(*KEYS).agg(*R.outcome_rates()))


@query
def release_consistency(spark, d):
    rows = R.with_season(cleaned(spark, d))
    return tidy(rows.groupBy(*KEYS).agg(F.count(P.LABEL).alias("n_pitches"), R.release_spread()))


@query
def display_name(spark, d):
    return R.display_names(cleaned(spark, d))


@query
def profile(spark, d):
    return tidy(R.profile(featured(spark, d), SHARED))


@query
def profile_two_scans(spark, d):
    return tidy(profiles(spark, d))


@query
def profile_co_located(spark, d):
    """Profiles from pitches that are stored by pitcher and season, without a shuffle of pitches."""
    path = scratch_path(spark, "bucketed")
    table = f"pitches_{path.rsplit('-', 1)[1]}"
    rows = pitch_view(spark, d).withColumn("season", F.year("game_date"))
    stored = S.write_bucketed(rows, table, path, S.buckets_for(rows), by=("pitcher", "season"))
    return tidy(profiles_from_raw(stored, SHARED, season="season"))


@query
def profile_incremental(spark, d):
    """Profiles after two deliveries, the second of which is all that the second call reads."""
    root, states = scratch_path(spark, "store"), scratch_path(spark, "states")
    rows = pitch_view(spark, d)
    L.replace_months(spark, rows.where(_FIRST_HALF), root, _TODAY)
    refresh_profiles(spark, root, states, SHARED)
    L.replace_months(spark, rows.where(f"NOT ({_FIRST_HALF})"), root, _TODAY)
    return tidy(refresh_profiles(spark, root, states, SHARED))


@query
def type_summary(spark, d):
    return R.type_summary(profiles(spark, d))


@query
def profile_summary(spark, d):
    return tidy(R.profile_summary(profiles(spark, d)))


# --- neighbours and standard scores -----------------------------------------

def _kept(spark, d):
    from pitchrank.plans.fused import prepare

    rows, _ = prepare(pitch_view(spark, d), SHARED)
    return R.keep_complete(R.summarize(rows, SHARED), rows.columns, SHARED)


@query
def nearest_in_group(spark, d):
    return tidy(add_tunnel_features(_kept(spark, d)).select(*KEYS, *P.TUNNEL_FEATURES))


@query
def tunnel_summary_(spark, d):
    return tidy(tunnel_summary(materialize(add_tunnel_features(_kept(spark, d)), "tunnel")))


@query
def zscore_in_group(spark, d):
    rows = materialize(add_tunnel_features(_kept(spark, d)), "tunnel")
    return tidy(add_zscores(rows).select(*KEYS, *[f"z_{c}" for c in P.ZSCORE_COLUMNS]))


@query
def zscore_events(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", "event_type", "value")
    return tidy(add_zscores(rows, ["value"], ["event_type"]).drop("value"))


# --- scores and boards ------------------------------------------------------

@query
def scaler(spark, d):
    rows = materialize(profiles(spark, d), "profiles")
    return tidy(fit_scaler(rows.where(F.col("season") < rows.select(F.max("season")).scalar()), P.LABEL))


@query
def plus_scale(spark, d):
    return tidy(scaled(spark, d).select(*KEYS, P.SCORE))


@query
def leaderboard_all(spark, d):
    return tidy(B.leaderboard(scaled(spark, d), 20))


@query
def leaderboard_type(spark, d):
    return tidy(B.leaderboard(scaled(spark, d), 20, group="fastball", pitch_type="SL"))


@query
def leaderboard_group(spark, d):
    return tidy(B.leaderboard(scaled(spark, d), 20, group="breaking"))


@query
def leaderboard_recent(spark, d):
    return tidy(B.leaderboard(B.most_recent(scaled(spark, d)), 20))


@query
def leaderboard_top20(spark, d):
    return tidy(B.top(B.leaderboard(B.most_recent(scaled(spark, d)), 20)))


def _with_places(board: DataFrame, column: str) -> DataFrame:
    """The place of each line of a board among those of its type or group, by the order the lines come in."""
    lines = board.withColumn("_line", F.monotonically_increasing_id())
    return lines.withColumn("place", F.row_number().over(Window.partitionBy(column).orderBy("_line"))).drop("_line")


@query
def leaderboard_all_types(spark, d):
    return tidy(_with_places(B.leaderboards_by(B.most_recent(scaled(spark, d)), "pitch_type", 20), "pitch_type"))


@query
def leaderboard_all_groups(spark, d):
    return tidy(_with_places(B.leaderboards_by(B.most_recent(scaled(spark, d)), "pitch_group", 20), "pitch_group"))


@query
def top20_events(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", "value")
    return tidy(B.top(rows.orderBy(F.desc("value"), "event_id")))


@query
def career(spark, d):
    return tidy(B.career(scaled(spark, d)))


@query
def score_histogram(spark, d):
    return tidy(V.score_histogram(scaled(spark, d)))


@query
def spearman_by_type(spark, d):
    return tidy(V.rank_correlations(scaled(spark, d)))


@query
def fit_metrics(spark, d):
    return tidy(V.fit_metrics(B.most_recent(scaled(spark, d)), "whiff_rate", "csw_rate"))


# --- models -----------------------------------------------------------------

@query
def time_split_(spark, d):
    return time_split(profiles(spark, d), 2000).select(*KEYS, "split")


@query
def train_set_(spark, d):
    rows = materialize(profiles(spark, d), "profiles")
    return train_set(rows, settings=SHARED).select(*KEYS, "n_pitches", "split", "rows_complete")


@query
def boost_first_split(spark, d):
    """The root of each type's first tree, all rows and columns being seen: where it splits, its gain, its leaves."""
    rows = materialize(profiles(spark, d), "profiles")
    chosen = train_set(rows, settings=SHARED)
    whole = replace(SHARED.small_boost, rounds=1, depth=1, subsample=1.0, column_sample=1.0)
    fitted = fit_boosters(chosen, list(P.MODEL_INPUTS), P.LABEL, {t: whole for t in SHARED.model_types}, "n_pitches")
    roots = [(t, b.base, b.inputs[b.trees[0].feature[0]], *(float(v) for v in (
        b.trees[0].threshold[0], b.trees[0].gain[0], b.trees[0].leaf[1], b.trees[0].leaf[2])))
        for t, b in fitted.items() if b.trees[0].feature[0] >= 0]  # one row a type
    return tidy(spark.createDataFrame(roots, "pitch_type string, base double, feature string, threshold double, "
                                             "gain double, leaf_left double, leaf_right double"))


@query
def boost_held_out(spark, d):
    """Charges of order lines by return flag, learned in the years before 1997 and checked in 1997.

    Whether the squared error is below half of the training mean's, and whether a second fit
    of the same rows, dealt otherwise, is the same.
    """
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    year = F.year("l_shipdate")
    rows = lines.select(
        F.col("l_returnflag").alias("pitch_type"), F.when(year < 1997, "train").when(year == 1997, "val").alias("split"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).cast("double").alias("charge"),
        F.col("l_extendedprice").cast("double").alias("price"),
        F.when(F.col("l_linenumber") > 1, F.col("l_discount").cast("double")).alias("discount"),
        F.col("l_quantity").cast("double").alias("quantity"), F.col("l_linenumber").cast("double").alias("w"))
    params = {k: replace(SHARED.standard_boost, rounds=6, learning_rate=0.3, column_sample=1.0, patience=2) for k in ("R", "A", "N")}
    inputs = ["price", "discount", "quantity"]
    first, second = (fit_boosters(r, inputs, "charge", params, "w") for r in (rows, rows.repartition(5)))
    same = {k: first[k].losses == second[k].losses for k in first}
    scored = with_predictions(rows.where("split = 'val'"), first, "predicted")
    base = F.element_at(F.create_map(*[F.lit(v) for k, b in first.items() for v in (k, b.base)]), F.col("pitch_type"))
    kept = F.element_at(F.create_map(*[F.lit(v) for k, b in first.items() for v in (k, same[k])]), F.col("pitch_type"))
    return scored.groupBy("pitch_type").agg(
        F.count(F.lit(1)).alias("n"), (F.avg((F.col("charge") - F.col("predicted")) ** 2)
                                       < 0.5 * F.avg((F.col("charge") - base) ** 2)).alias("halves_squares"),
        F.first(kept).alias("same_again")).withColumnRenamed("pitch_type", "returnflag")


_MODELS: dict = {}


def _trained(spark, d):
    """Profiles and their models; the queries of one session share the fit."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _MODELS:
        rows = materialize(profiles(spark, d), "profiles")
        _MODELS[key] = rows, train_models(rows, settings=SHARED)
    return _MODELS[key]


@query
def train(spark, d):
    """Rows each model learned from, and the mean and deviation of its training scores."""
    rows, models = _trained(spark, d)
    marked = score_profiles(train_set(rows, settings=SHARED), models)
    learned = F.when(F.col("split") == "train", F.col(P.SCORE))
    return tidy(marked.groupBy("pitch_type").agg(
        F.count_if(F.col("split") == "train").alias("train_rows"), F.count_if(F.col("split") == "val").alias("val_rows"),
        F.avg(learned).alias("score_mean"), F.stddev_pop(learned).alias("score_sd")))


@query
def train_limits(spark, d):
    """What the fits report: an error, and a best round within the method's rounds."""
    found = artifact_table(spark, _trained(spark, d)[1])
    return found.select("pitch_type", (F.col("rmse") > 0).alias("has_error"),
                        F.col("best_iteration").between(0, 399).alias("within_rounds"),
                        F.size("inputs").alias("n_inputs"))


@query
def score(spark, d):
    rows, models = _trained(spark, d)
    return score_profiles(rows, models).groupBy("pitch_type").agg(
        F.count(F.lit(1)).alias("profiles"), F.count(P.SCORE).alias("scored"),
        F.count_if(F.col(P.SCORE).isNull()).alias("unscored"))


@query
def job_tables(spark, d):
    """Rows of the tables that the five steps after fetching write, one run from a store to the boards.

    Models of three small trees are enough to pass every step.
    """
    root = scratch_path(spark, "job")
    L.replace_months(spark, pitch_view(spark, d), f"{root}/raw", _TODAY)
    seasons = tuple(r[0] for r in L.read_manifest(spark, f"{root}/raw").select("season").distinct().collect())
    few = {"rounds": 3, "depth": 2, "column_sample": 1.0}
    quick = replace(SHARED, standard_boost=replace(SHARED.standard_boost, **few), small_boost=replace(SHARED.small_boost, **few))
    jobs.run(spark, root, jobs.STEPS[1:], seasons=seasons, settings=quick)
    tables = {n: S.read_table(spark, f"{root}/{n}") for n in ("clean", "features", "profiles")}
    tables["scored"] = S.read_table(spark, f"{root}/scored").where(F.col(P.SCORE).isNotNull())
    tables["board"] = S.read_board(spark, f"{root}/boards/all")
    tables["board_by_type"] = S.read_board(spark, f"{root}/boards/by_type")
    tables["career"] = spark.read.option("header", True).csv(f"{root}/boards/career")
    return S.union_tables(*[t.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows")) for n, t in tables.items()])


@query
def feature_importance_(spark, d):
    """Per model: entries, whether places run without a gap and weights fall, and whether they sum to 1 at most."""
    places = feature_importance(spark, _trained(spark, d)[1])
    ordered = F.sort_array(F.collect_list(F.struct("place", "importance")))  # fifteen per type
    listed = places.groupBy("pitch_type").agg(F.count(F.lit(1)).alias("entries"), ordered.alias("list"))
    falls = F.forall(F.sequence(F.lit(1), F.size("list") - 1),
                     lambda i: F.get("list", i)["importance"] <= F.get("list", i - 1)["importance"])
    total = F.aggregate("list", F.lit(0.0), lambda a, x: a + x["importance"])
    return listed.select("pitch_type", "entries",
                         (F.get("list", F.size("list") - 1)["place"] == F.col("entries")).alias("without_gaps"),
                         falls.alias("falling"), (total <= 1 + 1e-9).alias("sums_to_one"))


@query
def model_roundtrip(spark, d):
    """Profiles, and those whose score changes when the models are written and read."""
    rows, models = _trained(spark, d)
    root = scratch_path(spark, "models")
    save_models(spark, models, root)
    before = score_profiles(rows, models).select(*KEYS, F.col(P.SCORE).alias("before"))
    after = score_profiles(rows, load_models(spark, root)).select(*KEYS, F.col(P.SCORE).alias("after"))
    both = before.join(after, KEYS)
    return both.agg(F.count(F.lit(1)).alias("profiles"),
                    F.count_if(~F.col("before").eqNullSafe(F.col("after"))).alias("changed"))
