"""Raw pitches to profiles in two scans.

Cleaning needs the size of each pitcher-season, the speed gap its mean fastball and
the profile each pitcher's usual name. Called one by one, each of them scans the
raw table. Here one narrow aggregate per (pitcher, season, name) gives all three,
and the second scan does everything else. The result is that of
``profile(build_features(clean(raw)))``. The raw table needs pitcher, date and name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchrank import params as P
from pitchrank.functions import codes
from pitchrank.operators import clean as C
from pitchrank.operators import features as X
from pitchrank.operators.joins import lookup_join
from pitchrank.operators.profile import finish_profiles, most_common_name, summarize
from pitchrank.params import DEFAULTS, Settings
from pitchrank.session import materialize

_KEYS = ["pitcher", C.SEASON_KEY]


def _screened(raw: DataFrame, season: str | None) -> DataFrame:
    return C.screen(raw).withColumn(C.SEASON_KEY, F.col(season) if season else F.year("game_date")).dropna(subset=_KEYS)


def pitcher_seasons(raw: DataFrame, settings: Settings = DEFAULTS, season: str | None = None) -> DataFrame:
    """Counts, fastball sums and names of each pitcher-season, from one scan."""
    rows = _screened(raw, season).transform(C.add_run_value).transform(C.add_pitch_group, settings.pitch_groups)
    usable = F.col(P.LABEL).isNotNull() & F.col("pitch_group").isNotNull()
    fastball = usable & X.is_fastball()
    speed = codes.clip(F.col("release_speed"), *P.CLIP_BOUNDS["release_speed"])
    return rows.groupBy(*_KEYS, "player_name").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(usable).alias("n"),
        F.count_if(fastball).alias("fastballs"),
        F.sum(F.when(fastball, speed)).alias("fastball_speed"),
    )


def prepare(raw: DataFrame, settings: Settings = DEFAULTS, season: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Pitch-level features, and the display names."""
    seasons = materialize(pitcher_seasons(raw, settings, season), "pitcher_seasons")
    totals = seasons.groupBy(*_KEYS).agg(
        F.sum("rows").alias("_rows"),
        F.try_divide(F.sum("fastball_speed"), F.sum("fastballs")).alias("_fastball"),
    ).where(F.col("_rows") >= settings.min_pitches_per_season)
    kept = lookup_join(_screened(raw, season), totals, _KEYS, "_rows", "inner")
    rows = (
        kept.transform(C.label_and_group, settings).transform(X.add_physics, settings)
        .withColumn("speed_diff", X.speed_gap(F.col("_fastball"), F.col("release_speed")))
        .drop("_fastball", C.SEASON_KEY)
    )
    if season:
        rows = rows.withColumnRenamed(season, "season").drop("game_date")
    # names count only pitches of kept pitcher-seasons, as the profile does
    regular = seasons.join(totals.select(*_KEYS), _KEYS, "left_semi")
    return rows, most_common_name(regular)


def profiles_from_raw(raw: DataFrame, settings: Settings = DEFAULTS, season: str | None = None) -> DataFrame:
    """The full profile table straight from raw pitches.

    ``season`` names a stored column that holds the year of the date. It is grouped by in place
    of that year, so that a table dealt by pitcher and season needs no shuffle.
    """
    rows, names = prepare(raw, settings, season)
    return finish_profiles(summarize(rows, settings), rows.columns, names, settings)
