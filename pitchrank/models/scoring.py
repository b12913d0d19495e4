"""Scoring profiles with the fitted models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchrank.functions import codes
from pitchrank.models.boosting import with_predictions
from pitchrank.models.training import RAW, TypeModel
from pitchrank.params import SCORE


def score_profiles(df: DataFrame, models: dict[str, TypeModel], score: str = SCORE) -> DataFrame:
    """Add the plus score of each row's own type; rows of types without a model get null.

    One pass over the rows, none of which is shuffled. A missing input goes the way that
    training found best, so every row of a modelled type has a score.
    """
    if not models:
        return df.withColumn(score, F.lit(None).cast("double"))
    raw = with_predictions(df, {t: m.model for t, m in models.items()}, RAW)
    s = {k: codes.lookup(F.col("pitch_type"), {t: float(m.scaler[k]) for t, m in models.items() if m.scaler[k] is not None})
         for k in ("mean_raw", "std_raw", "center", "scale")}
    value = codes.plus_score(F.col(RAW), s["mean_raw"], s["std_raw"], s["center"], s["scale"])
    return raw.withColumn(score, value).drop(RAW)
