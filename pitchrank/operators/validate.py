"""Checks of the scores against outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchrank.functions.codes import round_even
from pitchrank.operators.joins import lookup_join
from pitchrank.operators.ranks import rank_rows
from pitchrank.params import DEFAULTS, SCORE, Settings
from pitchrank.session import materialize

_RATES = ("whiff_rate", "csw_rate")


def safe_corr(x: str, y: str):
    """Pearson correlation; null without spread (``corr`` raises there under ANSI)."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when((F.min(x) < F.max(x)) & (F.min(y) < F.max(y)),
                  F.try_divide(F.covar_pop(x, y), spread))


def fit_metrics(df: DataFrame, actual: str, predicted: str, keys=("pitch_type",)) -> DataFrame:
    """Root mean squared error and correlation per group."""
    return df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg((F.col(actual) - F.col(predicted)) ** 2)).alias("rmse"),
        safe_corr(actual, predicted).alias("corr"),
    )


def rank_correlations(df: DataFrame, settings: Settings = DEFAULTS, score: str = SCORE) -> DataFrame:
    """Spearman correlation of the score with both outcome rates per type.

    Both measures and both sides are ranked in one pass; the two ranks of a row meet by its
    number. A correlation needs ``min_rank_pairs`` pairs; ``low`` flags one with the whiff
    rate that is too small.
    """
    rates = [c for c in _RATES if c in df.columns]
    labels = {"whiff_rate": "r_whiff", "csw_rate": "r_csw"}
    rows = df.where(F.col("pitch_type").isNotNull()).select(
        "pitch_type", F.col(score).alias("_x"), *rates, F.monotonically_increasing_id().alias("_row"))
    if not rates:
        wide = rows.groupBy("pitch_type").agg(F.count("_x").alias("n"))
    else:
        def side(measure, name, own, other):
            return F.struct(F.lit(measure).alias("measure"), F.lit(name).alias("side"),
                            F.when(F.col(other).isNotNull(), F.col(own)).cast("double").alias("value"))

        sides = rows.select("pitch_type", "_row", F.col("_x").isNotNull().alias("_scored"), F.explode(F.array(*[
            s for c in rates for s in (side(c, "x", "_x", c), side(c, "y", c, "_x"))])).alias("s")).select(
            "pitch_type", "_row", "_scored", "s.*")
        ranks = rank_rows(sides, ["pitch_type", "measure", "side"], "value")
        pairs = ranks.groupBy("pitch_type", "measure", "_row", "_scored").agg(*[
            F.max(F.when(F.col("side") == s, F.col("avg_rank"))).alias(f"r{s}") for s in ("x", "y")])
        by_measure = pairs.groupBy("pitch_type", "measure").agg(
            F.count_if("_scored").alias("n"),
            F.when(F.count("rx") >= settings.min_rank_pairs, safe_corr("rx", "ry")).alias("r"))
        wide = by_measure.groupBy("pitch_type").agg(F.max("n").alias("n"), *[
            round_even(F.max(F.when(F.col("measure") == c, F.col("r"))), 3).alias(labels[c]) for c in rates])
    absent = {labels[c]: F.lit(None).cast("double") for c in _RATES if c not in rates}
    out = wide.withColumns(absent) if absent else wide
    return out.select(
        "pitch_type", "n", "r_whiff", "r_csw",
        F.coalesce(F.col("r_whiff") < settings.low_rank_correlation, F.lit(False)).alias("low"),
    ).coalesce(1).sortWithinPartitions("pitch_type")  # a row a type


def score_histogram(df: DataFrame, bins: int = 40, group: str | None = None, score: str = SCORE) -> DataFrame:
    """Equal bins between the smallest and the largest score of each type, empty ones included.

    A type with a single value gets a bin range one wide around it.
    """
    if group:
        df = df.where(F.col("pitch_group") == group)
    scored = df.where(F.col(score).isNotNull() & F.col("pitch_type").isNotNull())
    scored = materialize(scored.select("pitch_type", F.col(score).alias("_x")), "scores")
    pad = F.when(F.min("_x") == F.max("_x"), F.lit(0.5)).otherwise(F.lit(0.0))
    ranges = materialize(scored.groupBy("pitch_type").agg(
        (F.min("_x") - pad).alias("low"), (F.max("_x") + pad).alias("high"),
        F.count(F.lit(1)).alias("_rows")), "ranges")
    # the largest value belongs to the last bin
    placed = lookup_join(scored, ranges, ["pitch_type"], "_rows").select(
        "pitch_type",
        F.least(F.width_bucket("_x", F.col("low"), F.col("high"), F.lit(bins)), F.lit(bins))
        .cast("int").alias("bin"))
    counts = placed.groupBy("pitch_type", "bin").agg(F.count(F.lit(1)).alias("n"))
    step = (F.col("high") - F.col("low")) / F.lit(bins)
    grid = ranges.select(
        "pitch_type", "low", "high", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    return grid.join(counts, ["pitch_type", "bin"], "left").select(
        "pitch_type", "bin",
        (F.col("low") + step * (F.col("bin") - 1)).alias("bin_low"),
        (F.col("low") + step * F.col("bin")).alias("bin_high"),
        F.coalesce("n", F.lit(0)).alias("n"))
