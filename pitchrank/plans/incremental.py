"""Profiles kept up to date from months of the store.

Every stored month leaves three small tables of states that add up over months: sums and
counts per profile key, counts of each speed per profile key, and counts, fastball sums and
names per pitcher. The two figures that need a whole pitcher-season, its size and the mean
of its fastballs, come from the pitchers' states; the gap to that mean, cut at zero, then
follows exactly from the counts of speeds. So pitches are read once, when their month is
new or has been replaced, which the version in the manifest tells, and a change rebuilds
the seasons it touches from states alone.

Under the root lie ``keys``, ``speeds``, ``pitchers`` and ``summaries`` by season, and
``done``, the versions taken in.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchrank import params as P
from pitchrank.functions import codes
from pitchrank.operators import clean as C
from pitchrank.operators import features as X
from pitchrank.operators.profile import averaged_inputs, finish_profiles, most_common_name
from pitchrank.params import DEFAULTS, Settings
from pitchrank.session import materialize
from pitchrank.sources.landing import PARTS
from pitchrank.sources.tables import read_store, write_table
from pitchrank.sources.versions import read_manifest

_KEYS = list(P.PROFILE_KEYS)
_SPREAD = ("release_pos_x", "release_pos_z")


def pitch_features(raw: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """What a profile needs of each pitch that passes the row-wise rules, bar the speed gap."""
    return (C.screen(raw).withColumns({"season": F.year("game_date"), "month": F.month("game_date")})
            .dropna(subset=["pitcher", "season"]).transform(C.label_and_group, settings).transform(X.add_physics, settings))


def _measured(rows: DataFrame, settings: Settings) -> list[str]:
    return [P.LABEL, *[c for c in averaged_inputs(rows, settings) if c != "speed_diff"], *P.TUNNEL_POSITIONS]


def key_states(rows: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Per month and profile key: pitches, and for every measure how many values and their sum."""
    measures = [F.count(F.lit(1)).alias("rows")]
    for c in _measured(rows, settings):
        measures += [F.count(c).alias(f"n_{c}"), F.sum(F.col(c).cast("double")).alias(f"sum_{c}")]
    for c in _SPREAD:
        measures.append(F.sum(F.col(c) * F.col(c)).alias(f"squares_{c}"))
    measures += [F.sum(codes.whiff(F.col("description"))).alias("whiffs"),
                 F.sum(codes.called_or_whiff(F.col("description"))).alias("csw")]
    return rows.dropna(subset=_KEYS).groupBy(*_KEYS, "month").agg(*measures)


def pitch_counts(raw: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Screened pitches per month, profile key, name and speed, and whether they are usable; keys may be null."""
    rows = C.screen(raw).withColumns({"season": F.year("game_date"), "month": F.month("game_date")}).dropna(
        subset=["pitcher", "season"]).transform(C.add_run_value).transform(
        C.add_pitch_group, settings.pitch_groups).transform(C.encode_hand)
    usable = F.col(P.LABEL).isNotNull() & F.col("pitch_group").isNotNull()
    speed = codes.clip(F.col("release_speed"), *P.CLIP_BOUNDS["release_speed"])
    return rows.withColumns({"usable": usable, "release_speed": speed}).groupBy(
        *_KEYS, "month", "player_name", "release_speed", "usable").agg(F.count(F.lit(1)).alias("n"))


def speed_states(rows: DataFrame) -> DataFrame:
    """Per month, profile key and speed: pitches; ``rows`` are pitches, or stand for ``n`` each."""
    n = F.sum("n") if "n" in rows.columns else F.count(F.lit(1))
    return rows.dropna(subset=_KEYS).groupBy(*_KEYS, "month", "release_speed").agg(n.alias("n"))


def pitcher_states(raw: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Per month, pitcher and name: screened pitches, usable ones, fastballs and the sum of their speeds."""
    return pitchers_of(pitch_counts(raw, settings))


def pitchers_of(counts: DataFrame) -> DataFrame:
    """``pitcher_states`` from the counts of ``pitch_counts``."""
    fastball = F.col("usable") & X.is_fastball()
    return counts.groupBy("pitcher", "season", "month", "player_name").agg(
        F.sum("n").alias("rows"), F.sum(F.when(F.col("usable"), F.col("n")).otherwise(0)).alias("n"),
        F.sum(F.when(fastball, F.col("n")).otherwise(0)).alias("fastballs"),
        F.sum(F.when(fastball, F.col("release_speed") * F.col("n"))).alias("fastball_speed"))


def summaries_of(keys: DataFrame, speeds: DataFrame, pitchers: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The rows of ``summarize``, from states of whole seasons."""
    totals = pitchers.groupBy("pitcher", "season").agg(
        F.sum("rows").alias("_rows"), F.try_divide(F.sum("fastball_speed"), F.sum("fastballs")).alias("_fastball"),
    ).where(F.col("_rows") >= settings.min_pitches_per_season).drop("_rows")
    names = [c for c in keys.columns if c not in (*_KEYS, "month")]
    merged = keys.join(totals.select("pitcher", "season"), ["pitcher", "season"], "left_semi").groupBy(*_KEYS).agg(
        *[F.sum(c).alias(c) for c in names])
    gap = X.speed_gap(F.col("_fastball"), F.col("release_speed"))
    gaps = speeds.join(totals, ["pitcher", "season"]).groupBy(*_KEYS).agg(
        (F.sum(gap * F.col("n")) / F.sum("n")).alias("speed_diff"))

    def deviation(c):
        n, total = F.col(f"n_{c}"), F.col(f"sum_{c}")
        squares = F.greatest(F.col(f"squares_{c}") - F.try_divide(total * total, n), F.lit(0.0))
        return F.coalesce(F.when(n > 1, squares / (n - 1)), F.lit(0.0))

    means = [F.try_divide(F.col(f"sum_{c}"), F.col(f"n_{c}")).alias(c)
             for c in (n.removeprefix("sum_") for n in names if n.startswith("sum_"))]
    out = merged.select(
        *_KEYS, F.col(f"n_{P.LABEL}").alias("n_pitches"), *means,
        (F.col("whiffs") / F.col("rows")).alias("whiff_rate"), (F.col("csw") / F.col("rows")).alias("csw_rate"),
        F.sqrt(reduce(lambda a, b: a + b, [deviation(c) for c in _SPREAD])).alias("release_consistency"))
    return out.join(gaps, _KEYS)


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """A table under the root, None before the first call; rows without a pitcher only mark a season."""
    try:
        found = spark.read.parquet(path)
        return found.where("pitcher IS NOT NULL") if "pitcher" in found.columns else found
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def changed_months(spark: SparkSession, store: str, root: str) -> list[tuple[int, int, str | None]]:
    """(season, month, version) of the store's months that differ from what was taken in; no version for one that is gone."""
    listed = read_manifest(spark, store).select(*PARTS, "version")
    done = _read(spark, f"{root}/done")
    if done is None:
        done = listed.limit(0)
    both = listed.join(done.withColumnRenamed("version", "_taken"), list(PARTS), "full").where(
        ~F.col("version").eqNullSafe(F.col("_taken")))
    return [tuple(r) for r in both.select(*PARTS, "version").collect()]  # calendar months


def refresh_profiles(spark: SparkSession, store: str, root: str, settings: Settings = DEFAULTS) -> DataFrame:
    """Take in the months that have changed since the last call and return all profiles.

    Only those months are read from the store, which has to be a versioned one, and only
    their seasons are summed up again. ``done`` is written last, so a call that breaks off
    is made good by the next one.
    """
    changed = changed_months(spark, store, root)
    if changed:
        _take_in(spark, store, root, changed, settings)
    summaries, pitchers = _read(spark, f"{root}/summaries"), _read(spark, f"{root}/pitchers")
    if summaries is None:
        raise FileNotFoundError(f"no months stored under {store}: ingest some first")
    regular = pitchers.groupBy("pitcher", "season").agg(F.sum("rows").alias("_rows")).where(
        F.col("_rows") >= settings.min_pitches_per_season).select("pitcher", "season")
    names = most_common_name(pitchers.join(regular, ["pitcher", "season"], "left_semi"))
    ordered = summaries.select(*_KEYS, *[c for c in summaries.columns if c not in _KEYS])
    return finish_profiles(ordered, [*summaries.columns, "player_name"], names, settings)


def _take_in(spark: SparkSession, store: str, root: str, changed: list, settings: Settings) -> None:
    seasons = sorted({s for s, _, _ in changed})
    months = F.lit(False)
    for season, month, _ in changed:
        months = months | ((F.col("season") == season) & (F.col("month") == month))
    raw = read_store(spark, store).where(months).drop("season", "month")
    counts = materialize(pitch_counts(raw, settings), "counts")
    states = {"keys": key_states(pitch_features(raw, settings), settings), "speeds": speed_states(counts.where("usable")),
              "pitchers": pitchers_of(counts)}
    for name, new in states.items():
        new = materialize(new, name)
        old = _read(spark, f"{root}/{name}")
        # what a season's other months have left, and the changed months as they are now
        kept = new if old is None else old.where(F.col("season").isin(seasons) & ~months).unionByName(new)
        states[name] = materialize(kept, name)
    states["summaries"] = summaries_of(states["keys"], states["speeds"], states["pitchers"], settings)
    for name, rows in states.items():
        # a season that has no rows left is written too, as a mark
        marks = spark.createDataFrame([(s,) for s in seasons], "season int")
        write_table(rows.unionByName(marks, allowMissingColumns=True), f"{root}/{name}",
                    partition_by=["season"], overwrite="dynamic")
    read_manifest(spark, store).select(*PARTS, "version").coalesce(1).write.mode("overwrite").parquet(f"{root}/done")
