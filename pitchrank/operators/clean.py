"""From raw pitches to clean, labelled pitches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchrank import params as P
from pitchrank.functions import codes
from pitchrank.operators.joins import lookup_join
from pitchrank.params import DEFAULTS, Settings
from pitchrank.schema import game_day, nan_to_null

SEASON_KEY = "_season"


def normalize_codes(df: DataFrame) -> DataFrame:
    """Replace legacy pitch codes and drop rows that are no pitch."""
    return (df.withColumn("pitch_type", codes.normal_code(F.col("pitch_type")))
              .where(F.col("pitch_type").isNotNull()))


def parse_dates(df: DataFrame) -> DataFrame:
    """Make ``game_date`` a date; unreadable text becomes null."""
    if "game_date" not in df.columns:
        return df
    return df.withColumn("game_date", game_day(F.col("game_date"), df.schema["game_date"].dataType))


def drop_incomplete(df: DataFrame, required=P.REQUIRED_COLUMNS) -> DataFrame:
    """Drop rows with a null in a required column; absent columns are not required."""
    return df.dropna(subset=[c for c in required if c in df.columns])


def drop_slow(df: DataFrame) -> DataFrame:
    """Drop pitches below their type's speed floor."""
    return df.where(codes.fast_enough(F.col("pitch_type"), F.col("release_speed")))


def screen(df: DataFrame) -> DataFrame:
    """The row-wise rules that come before any count; NaN counts as null."""
    return df.transform(nan_to_null).transform(normalize_codes).transform(parse_dates) \
             .transform(drop_incomplete).transform(drop_slow)


def drop_rare_pitchers(df: DataFrame, minimum: int) -> DataFrame:
    """Keep pitcher-seasons with at least ``minimum`` rows.

    The counts are a partial aggregate over two columns, and the rows are then
    filtered where they lie. Rows without pitcher or date belong to no season.
    """
    if not {"game_date", "pitcher"} <= set(df.columns):
        return df
    keys = ["pitcher", SEASON_KEY]
    dated = df.withColumn(SEASON_KEY, F.year("game_date"))
    regular = (
        dated.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") >= minimum)
    )
    return lookup_join(dated, regular, keys, "_rows", "left_semi").drop(SEASON_KEY)


def add_run_value(df: DataFrame) -> DataFrame:
    """Label every pitch with its runs, weighted by the count it was thrown in."""
    present = set(df.columns)
    value = codes.run_value(
        F.col("description"),
        F.col("type") if "type" in present else None,
        F.col("estimated_woba_using_speedangle")
        if "estimated_woba_using_speedangle" in present else None,
    )
    if {"balls", "strikes"} <= present:
        value = value * codes.count_weight(F.col("balls"), F.col("strikes"))
    return df.withColumn(P.LABEL, value)


def drop_unlabelled(df: DataFrame) -> DataFrame:
    return df.dropna(subset=[P.LABEL])


def add_pitch_group(df: DataFrame, groups=P.PITCH_GROUPS) -> DataFrame:
    return df.withColumn("pitch_group", codes.pitch_group(F.col("pitch_type"), groups))


def drop_ungrouped(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["pitch_group"])


def clip_columns(df: DataFrame, bounds=P.CLIP_BOUNDS) -> DataFrame:
    """Clip sensor and entry errors; nulls stay null."""
    present = {c: b for c, b in bounds.items() if c in df.columns}
    if not present:
        return df
    return df.withColumns({c: codes.clip(F.col(c), *b) for c, b in present.items()})


def encode_hand(df: DataFrame) -> DataFrame:
    if "p_throws" not in df.columns:
        return df
    return df.withColumn("p_throws_enc", codes.hand_flag(F.col("p_throws")))


def label_and_group(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The row-wise rules that come after the pitcher-season count."""
    return (
        df.transform(add_run_value).transform(drop_unlabelled)
        .transform(add_pitch_group, settings.pitch_groups).transform(drop_ungrouped)
        .transform(clip_columns).transform(encode_hand)
    )


def clean(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """All cleaning rules, in the order that decides which rows are counted."""
    return (
        df.transform(screen)
        .transform(drop_rare_pitchers, settings.min_pitches_per_season)
        .transform(label_and_group, settings)
    )


# --- reports ----------------------------------------------------------------

def _flagged(df: DataFrame, settings: Settings) -> DataFrame:
    """Every raw row with the first rule that drops it in ``_rule`` (null if kept)."""
    coded = parse_dates(nan_to_null(df).withColumn("pitch_type", codes.normal_code(F.col("pitch_type"))))
    required = [c for c in P.REQUIRED_COLUMNS if c in df.columns and c != "pitch_type"]
    missing = F.lit(False)
    for c in required:
        missing = missing | F.col(c).isNull()
    rule = (
        F.when(F.col("pitch_type").isNull(), "no_pitch")
        .when(missing, "incomplete")
        .when(~codes.fast_enough(F.col("pitch_type"), F.col("release_speed")), "below_floor")
    )
    labelled = coded.transform(add_run_value).transform(add_pitch_group, settings.pitch_groups)
    late = (
        F.when(F.col(P.LABEL).isNull(), "no_label").when(F.col("pitch_group").isNull(), "no_group")
    )
    keys = ["pitcher", SEASON_KEY]
    rows = labelled.withColumns({"_early": rule, SEASON_KEY: F.year("game_date")})
    counts = (
        rows.dropna(subset=keys).groupBy(*keys)
        .agg(F.count_if(F.col("_early").isNull()).alias("_kept"), F.count(F.lit(1)).alias("_rows"))
    )
    regular = F.coalesce(F.col("_kept") >= settings.min_pitches_per_season, F.lit(False))
    return lookup_join(rows, counts, keys, "_rows").withColumn(
        "_rule",
        F.when(F.col("_early").isNotNull(), F.col("_early")).when(~regular, "rare_pitcher").otherwise(late),
    )


def clean_report(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One row: rows in, rows dropped per rule, rows out, and the label of what is left."""
    rules = ("no_pitch", "incomplete", "below_floor", "rare_pitcher", "no_label", "no_group")
    flagged = _flagged(df, settings)
    kept = F.col("_rule").isNull()
    label = F.when(kept, F.col(P.LABEL))
    clipped = {
        c: F.count_if(kept & ((F.col(c) < low) | (F.col(c) > high)))
        for c, (low, high) in P.CLIP_BOUNDS.items() if c in df.columns
    }
    return flagged.agg(
        F.count(F.lit(1)).alias("rows_in"),
        *[F.count_if(F.col("_rule") == r).alias(r) for r in rules],
        F.count_if(kept).alias("rows_out"),
        F.avg(label).alias("label_mean"),
        F.stddev_samp(label).alias("label_sd"),
        *[n.alias(f"clipped_{c}") for c, n in clipped.items()],
    )


def floor_drops(df: DataFrame) -> DataFrame:
    """Pitches under the floor per type, with the fastest of them."""
    candidates = df.transform(normalize_codes).transform(drop_incomplete)
    slow = ~codes.fast_enough(F.col("pitch_type"), F.col("release_speed"))
    return candidates.where(slow).groupBy("pitch_type").agg(
        F.count(F.lit(1)).alias("n_dropped"), F.max("release_speed").alias("max_speed"))


def unknown_groups(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Labelled pitches per type that belongs to no group."""
    return (
        _flagged(df, settings).where(F.col("_rule") == "no_group")
        .groupBy("pitch_type").agg(F.count(F.lit(1)).alias("n"))
    )


def unknown_descriptions(df: DataFrame, top: int = 10, settings: Settings = DEFAULTS) -> DataFrame:
    """The most frequent outcomes that give no label, of pitches that pass all rules before the label."""
    return (
        df.transform(screen).transform(drop_rare_pitchers, settings.min_pitches_per_season).transform(add_run_value)
        .where(F.col(P.LABEL).isNull() & F.col("description").isNotNull())
        .groupBy("description").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "description").limit(top)
    )
