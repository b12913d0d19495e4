"""Exact ranks and medians within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchrank.operators.joins import lookup_join
from pitchrank.session import materialize


def ordered_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per group and distinct value: rows with it (``n_at``), below it (``n_before``), in all (``n_total``).

    A group may hold most of the rows, so it is never ordered in one task. Equal
    values are counted first; the distinct ones are cut into even ranges over
    (group, value); each range sums up on its own and then adds what the ranges
    before it hold. Ranges and groups cut one ordered line, so there are at most
    ranges + groups such totals.
    """
    counted = (
        df.where(F.col(value).isNotNull() & ~F.isnan(value))
        .groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n_at"))
    )
    # the cut points are sampled, so the placement is written down before it is used
    placed = materialize(
        counted.repartitionByRange(*keys, value).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = placed.groupBy("_range", *keys).agg(
        F.sum("n_at").alias("_held"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_range", *keys, "_rows",
        F.coalesce(F.sum("_held").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_held").over(Window.partitionBy(*keys)).alias("n_total"),
    )
    within = (Window.partitionBy("_range", *keys).orderBy(value)
              .rowsBetween(Window.unboundedPreceding, -1))
    local = placed.withColumn("_below", F.coalesce(F.sum("n_at").over(within), F.lit(0)))
    return lookup_join(local, offsets, ["_range", *keys], "_rows").select(
        *keys, value, "n_at", (F.col("_below") + F.col("_offset")).alias("n_before"), "n_total")


def average_ranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rank of each distinct value within its group, ties sharing their mean rank."""
    return ordered_counts(df, keys, value).select(
        *keys, value, "n_at",
        (F.col("n_before") + (F.col("n_at") + F.lit(1)) / F.lit(2.0)).alias("avg_rank"))


def rank_rows(df: DataFrame, keys: list[str], value: str, out: str = "avg_rank") -> DataFrame:
    """``df`` with the rank of each row's value within its group, ties sharing their mean rank.

    Rows are placed along the line of all (group, value) in even ranges, each is ranked within
    its range, and what the ranges before it hold is added; rows are never joined on their
    value. A value that fills several ranges is the first or last value of each, so totals
    for these two are enough to rank it: there are at most ranges + groups rows of totals.
    Null and NaN values have no rank and count for nothing.
    """
    known = F.col(value).isNotNull() & ~F.isnan(value)
    spread = {"_order": F.monotonically_increasing_id()}  # equal values may lie in several ranges
    placed = materialize(
        df.withColumns(spread).repartitionByRange(*keys, value, "_order").withColumn("_range", F.spark_partition_id())
        .drop("_order"), "ranges")
    ranked = placed.where(known)
    within = Window.partitionBy("_range", *keys).orderBy(value)
    local = ranked.withColumns({
        "_lower": F.rank().over(within) - 1, "_same": F.count(F.lit(1)).over(Window.partitionBy("_range", *keys, value))})
    held = local.groupBy("_range", *keys).agg(
        F.count(F.lit(1)).alias("_rows"), F.min(value).alias("_low"), F.max(value).alias("_high"),
        F.min_by("_same", value).alias("_n_low"), F.max_by("_same", value).alias("_n_high"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    one = F.struct(F.col("_low").alias("v"), F.col("_n_low").alias("n"), F.col("_before").alias("below"))
    two = F.struct(F.col("_high").alias("v"), F.col("_n_high").alias("n"),
                   (F.col("_before") + F.col("_rows") - F.col("_n_high")).alias("below"))
    ends = held.select("_range", *keys, "_before", "_low", "_high", F.explode(
        F.when(F.col("_low") == F.col("_high"), F.array(one)).otherwise(F.array(one, two))).alias("end"))
    same = Window.partitionBy(*keys, "end.v")
    ends = ends.withColumns({"_n": F.sum("end.n").over(same), "_below": F.min("end.below").over(same)})
    first, last = F.col("end.v") == F.col("_low"), F.col("end.v") == F.col("_high")
    totals = ends.groupBy("_range", *keys).agg(
        F.first("_before").alias("_before"), F.first("_low").alias("_low"), F.first("_high").alias("_high"),
        *[F.max(F.when(at, F.struct("_below", "_n"))).alias(name) for at, name in ((first, "_at_low"), (last, "_at_high"))])

    here = F.struct((F.col("_lower") + F.col("_before")).alias("_below"), F.col("_same").alias("_n"))
    place = F.when(F.col(value) == F.col("_low"), F.col("_at_low")).when(
        F.col(value) == F.col("_high"), F.col("_at_high")).otherwise(here)
    mine = totals.select(F.col("_range").alias("_at"), *[F.col(k).alias(f"_{n}") for n, k in enumerate(keys)],
                         "_before", "_low", "_high", "_at_low", "_at_high")
    met = F.col("_at") == F.col("_range")
    for n, k in enumerate(keys):  # a null key is a group like any other
        met = met & F.col(f"_{n}").eqNullSafe(F.col(k))
    done = local.join(mine, met).withColumn("_place", place).select(
        *df.columns, (F.col("_place._below") + (F.col("_place._n") + 1) / F.lit(2.0)).alias(out))
    rest = placed.where(~F.coalesce(known, F.lit(False))).select(*df.columns, F.lit(None).cast("double").alias(out))
    return done.unionByName(rest)


def median_of(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact median per group, without holding a group's values in one buffer."""
    first = F.floor((F.col("n_total") + 1) / 2)
    last = F.ceil((F.col("n_total") + 1) / 2)
    middle = (F.col("n_before") < last) & (F.col("n_before") + F.col("n_at") >= first)
    return (
        ordered_counts(df, keys, value).where(middle)
        .groupBy(*keys).agg(((F.min(value) + F.max(value)) / 2).alias("median"))
    )
