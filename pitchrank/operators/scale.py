"""Putting raw predictions on the plus scale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchrank.functions import codes
from pitchrank.operators.joins import lookup_join
from pitchrank.params import DEFAULTS, SCORE, Settings


def fit_scaler(train: DataFrame, raw: str, settings: Settings = DEFAULTS) -> DataFrame:
    """Mean and population deviation of the raw predictions per type."""
    return train.groupBy("pitch_type").agg(
        F.avg(raw).alias("mean_raw"),
        F.stddev_pop(raw).alias("std_raw"),
        F.lit(settings.center).alias("center"),
        F.lit(settings.scale).alias("scale"),
    )


def apply_scaler(df: DataFrame, scaler: DataFrame, raw: str, score: str = SCORE) -> DataFrame:
    """Score every row with its type's scaler; a type without one gets null."""
    lookup = scaler.select("pitch_type", "mean_raw", "std_raw", "center", "scale")
    joined = lookup_join(df, lookup, ["pitch_type"])
    value = codes.plus_score(
        F.col(raw), F.col("mean_raw"), F.col("std_raw"), F.col("center"), F.col("scale"))
    return joined.withColumn(score, value).drop("mean_raw", "std_raw", "center", "scale")
