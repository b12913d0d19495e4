"""Declared schemas and the helpers that bring foreign tables into them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_GROUPS = {
    "identifiers": (
        ("game_date", T.DateType()),
        ("game_pk", T.LongType()),
        ("pitcher", T.LongType()),
        ("player_name", T.StringType()),
        ("batter", T.LongType()),
        ("inning", T.IntegerType()),
        ("inning_topbot", T.StringType()),
        ("at_bat_number", T.IntegerType()),
        ("pitch_number", T.IntegerType()),
        ("pitch_type", T.StringType()),
        ("pitch_name", T.StringType()),
    ),
    "characteristics": tuple(
        (name, T.DoubleType())
        for name in (
            "release_speed", "pfx_x", "pfx_z", "release_spin_rate", "spin_axis",
            "release_pos_x", "release_pos_y", "release_pos_z", "release_extension",
            "plate_x", "plate_z", "vx0", "vy0", "vz0", "ax", "ay", "az",
        )
    ),
    "outcomes": (
        ("delta_run_exp", T.DoubleType()),
        ("estimated_woba_using_speedangle", T.DoubleType()),
        ("launch_speed", T.DoubleType()),
        ("launch_angle", T.DoubleType()),
        ("events", T.StringType()),
        ("description", T.StringType()),
        ("type", T.StringType()),
        ("zone", T.IntegerType()),
        ("balls", T.IntegerType()),
        ("strikes", T.IntegerType()),
    ),
    "context": (
        ("stand", T.StringType()),
        ("p_throws", T.StringType()),
        ("if_fielding_alignment", T.StringType()),
        ("of_fielding_alignment", T.StringType()),
    ),
}

PITCH_SCHEMA = T.StructType(
    [T.StructField(name, kind) for group in _GROUPS.values() for name, kind in group]
)
KEEP_COLUMNS = tuple(PITCH_SCHEMA.fieldNames())

MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("rows", T.LongType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("fetched_at", T.TimestampType()),
        T.StructField("is_complete", T.BooleanType()),
        T.StructField("season", T.IntegerType()),
        T.StructField("month", T.IntegerType()),
        T.StructField("version", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
    ]
)


def keep_columns(df: DataFrame, wanted=KEEP_COLUMNS) -> DataFrame:
    """Wanted columns that are present, in wanted order."""
    present = set(df.columns)
    return df.select([c for c in wanted if c in present])


def ensure_columns(df: DataFrame, columns: dict) -> DataFrame:
    """Add typed null columns for those of ``columns`` (name -> type) that are absent."""
    absent = {c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns}
    return df.withColumns(absent) if absent else df


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into null in every floating column.

    Aggregates skip nulls but carry NaN on, and NaN compares above every number.
    """
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def as_pitches(df: DataFrame) -> DataFrame:
    """Cast a loosely typed pitch table to the declared schema, keeping absent columns absent.

    ``game_date`` may be a date, a timestamp, text, or a long of nanoseconds (what a
    Parquet TIMESTAMP(NANOS) column becomes under ``spark.sql.legacy.parquet.nanosAsLong``).
    Text that is no date, number or count becomes null.
    """
    kept = keep_columns(df)
    casts = {}
    for field in kept.schema:
        wanted = PITCH_SCHEMA[field.name].dataType
        if field.name == "game_date":
            casts[field.name] = game_day(F.col(field.name), field.dataType)
        elif field.dataType != wanted:
            casts[field.name] = F.col(field.name).try_cast(wanted)
    return nan_to_null(kept.withColumns(casts) if casts else kept)


def game_day(column, kind: T.DataType):
    """Calendar day of a date, timestamp, text or nanosecond column; null if unreadable."""
    if isinstance(kind, T.DateType):
        return column
    if isinstance(kind, T.StringType):
        return F.to_date(F.try_to_timestamp(column))
    if isinstance(kind, T.LongType):
        # pandas writes NaT as the smallest long
        micros = F.floor(column / F.lit(1000)).cast("long")
        return F.when(column > F.lit(-(2**63) + 1), F.to_date(F.timestamp_micros(micros)))
    return F.to_date(column)
