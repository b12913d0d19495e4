"""From pitches to one row per pitcher, season and pitch type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchrank import params as P
from pitchrank.functions import codes
from pitchrank.operators.tunnel import add_tunnel_features
from pitchrank.operators.zscore import add_zscores
from pitchrank.params import DEFAULTS, Settings
from pitchrank.schema import game_day
from pitchrank.session import materialize

_OPTIONAL = {"release_consistency", *P.TUNNEL_FEATURES}


def with_season(df: DataFrame) -> DataFrame:
    """Season from the date, else the season column as it is."""
    if "game_date" in df.columns:
        return df.withColumn("season", F.year(game_day(F.col("game_date"), df.schema["game_date"].dataType)))
    if "season" not in df.columns:
        raise ValueError("the table needs a game_date or a season column")
    return df


def averaged_inputs(df: DataFrame, settings: Settings = DEFAULTS) -> list[str]:
    """Model inputs that exist per pitch and are not part of the profile key."""
    return [c for c in settings.model_inputs if c in df.columns and c not in P.PROFILE_KEYS]


def _mean(column: str, settings: Settings):
    if column == "spin_axis" and settings.circular_spin_mean:
        angle = F.radians(column)
        mean = F.degrees(F.atan2(F.avg(F.sin(angle)), F.avg(F.cos(angle))))
        return F.pmod(mean, F.lit(360.0))
    return F.avg(column)


def outcome_rates() -> list:
    """Shares of pitches missed, and of pitches missed or called strikes."""
    return [
        F.avg(codes.whiff(F.col("description"))).alias("whiff_rate"),
        F.avg(codes.called_or_whiff(F.col("description"))).alias("csw_rate"),
    ]


def release_spread():
    """Root sum of squares of the two sample deviations; an undefined one counts as 0."""
    def deviation(c):
        return F.coalesce(F.stddev_samp(c), F.lit(0.0))

    x, z = deviation("release_pos_x"), deviation("release_pos_z")
    return F.sqrt(x * x + z * z).alias("release_consistency")


def summarize(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One partial and one final aggregate over the profile key; all buffers have fixed size."""
    if P.LABEL not in df.columns:
        raise ValueError(f"column {P.LABEL} is missing: clean the pitches first")
    rows = with_season(df).dropna(subset=list(P.PROFILE_KEYS))
    present = set(rows.columns)
    measures = [F.count(P.LABEL).alias("n_pitches"), F.avg(P.LABEL).alias(P.LABEL)]
    measures += [_mean(c, settings).alias(c) for c in averaged_inputs(rows, settings)]
    measures += [F.avg(c).alias(c) for c in P.TUNNEL_POSITIONS if c in present]
    if "description" in present:
        measures += outcome_rates()
    if {"release_pos_x", "release_pos_z"} <= present:
        measures.append(release_spread())
    return rows.groupBy(*P.PROFILE_KEYS).agg(*measures)


def keep_complete(profiles: DataFrame, df_columns, settings: Settings = DEFAULTS) -> DataFrame:
    """Drop thin profiles and those without a mean for a required input."""
    required = [
        c for c in settings.model_inputs
        if c in df_columns and c in profiles.columns
        and c not in P.PROFILE_KEYS and c not in _OPTIONAL
    ]
    return (profiles.where(F.col("n_pitches") >= settings.min_pitches_per_type)
                    .dropna(subset=[*required, P.LABEL]))


def most_common_name(counts: DataFrame) -> DataFrame:
    """The most frequent name of each pitcher, the first in text order on ties.

    ``counts`` holds (pitcher, player_name, n). Two aggregates, so that no task
    ever holds all names of one pitcher.
    """
    return (
        counts.where(F.col("player_name").isNotNull() & F.col("pitcher").isNotNull())
        .groupBy("pitcher", "player_name").agg(F.sum("n").alias("n"))
        .where(F.col("n") > 0)
        .groupBy("pitcher")
        .agg(F.min_by("player_name", F.struct(-F.col("n"), F.col("player_name"))).alias("player_name"))
    )


def display_names(df: DataFrame) -> DataFrame:
    """Display name of each pitcher over all seasons."""
    return most_common_name(
        df.groupBy("pitcher", "player_name").agg(F.count(F.lit(1)).alias("n")))


def finish_profiles(summaries: DataFrame, pitch_columns, names: DataFrame | None,
                    settings: Settings = DEFAULTS) -> DataFrame:
    """Filters, names, neighbours and z-scores on top of the summaries.

    A pitcher has few profiles (seasons x types), so the name join has no hot key.
    The rows before the z-scores are written once, since both their group
    statistics and the result read them.
    """
    profiles = summaries.transform(keep_complete, pitch_columns, settings)
    if names is not None:
        profiles = profiles.join(names, "pitcher", "left")
    profiles = materialize(add_tunnel_features(profiles), "profiles")
    return add_zscores(profiles, settings.zscore_columns)


def profile(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Pitch-level features to the full profile table."""
    names = display_names(df) if "player_name" in df.columns else None
    return finish_profiles(summarize(df, settings), df.columns, names, settings)


def type_summary(profiles: DataFrame) -> DataFrame:
    """Profiles and pitches per type, most pitches first."""
    return (
        profiles.groupBy("pitch_type")
        .agg(F.count("n_pitches").alias("profiles"), F.sum("n_pitches").alias("total_pitches"))
        .orderBy(F.desc("total_pitches"), "pitch_type")
    )


def profile_summary(profiles: DataFrame) -> DataFrame:
    """One row: number of profiles, mean and deviation of the label, mean pitches."""
    return profiles.agg(
        F.count(F.lit(1)).alias("profiles"),
        F.avg(P.LABEL).alias("label_mean"),
        F.stddev_samp(P.LABEL).alias("label_sd"),
        F.avg("n_pitches").alias("mean_pitches"),
    )
