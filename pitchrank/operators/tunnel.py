"""How alike the pitches of one arsenal look at the decision point."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchrank import params as P
from pitchrank.operators.ranks import median_of

ARSENAL = ("pitcher", "season")
_MEMBER = ("pitch_type", "pitch_group", "p_throws_enc")


def add_tunnel_features(profiles: DataFrame) -> DataFrame:
    """Distance to the nearest other pitch of the arsenal, and how far the pair parts by the plate.

    The profile key makes a row unique by type and hand, so an arsenal has at most
    two rows per known type. Each row looks through its arsenal's short list; no
    pairs are built, and one exchange on the arsenal key is all that moves. Ties go
    to the first in key order. The position columns are dropped.
    """
    positions = [c for c in P.TUNNEL_POSITIONS if c in profiles.columns]
    if not {"tunnel_x", "tunnel_z"} <= set(positions):
        return profiles.withColumns({c: F.lit(None).cast("double") for c in P.TUNNEL_FEATURES})
    has_plate = {"plate_x_kin", "plate_z_kin"} <= set(positions)
    plate = {
        "px": F.col("plate_x_kin") if has_plate else F.lit(None).cast("double"),
        "pz": F.col("plate_z_kin") if has_plate else F.lit(None).cast("double"),
    }
    located = F.col("tunnel_x").isNotNull() & F.col("tunnel_z").isNotNull()
    me = F.struct(*_MEMBER)
    entry = F.struct(
        me.alias("key"), F.col("tunnel_x").alias("tx"), F.col("tunnel_z").alias("tz"),
        *[c.alias(n) for n, c in plate.items()],
    )
    arsenal = F.collect_list(F.when(located, entry)).over(Window.partitionBy(*ARSENAL))

    def seen_from_here(other):
        return F.struct(
            F.hypot(other["tx"] - F.col("tunnel_x"), other["tz"] - F.col("tunnel_z")).alias("apart"),
            other["key"].alias("key"),
            F.hypot(other["px"] - plate["px"], other["pz"] - plate["pz"]).alias("apart_at_plate"),
        )

    others = F.filter(F.col("_arsenal"), lambda o: o["key"] != me)
    nearest = F.when(located, F.array_min(F.transform(others, seen_from_here)))
    parting = F.least(
        F.try_divide(F.col("_nearest.apart_at_plate"), F.col("_nearest.apart")),
        F.lit(P.TUNNEL_RATIO_CAP),
    )
    usable = (F.col("_nearest.apart") > P.TUNNEL_MIN_DISTANCE) & F.col("_nearest.apart_at_plate").isNotNull()
    return (
        profiles.withColumn("_arsenal", arsenal)
        .withColumn("_nearest", nearest)
        .withColumns({
            "tunnel_dist_nearest": F.col("_nearest.apart"),
            "tunnel_ratio_nearest": F.when(usable, parting),
        })
        .drop("_arsenal", "_nearest", *positions)
    )


def tunnel_summary(profiles: DataFrame) -> DataFrame:
    """One row: profiles with and without a neighbour, mean and exact median of both features."""
    dist, ratio = P.TUNNEL_FEATURES
    counts = profiles.agg(
        F.count(dist).alias("n_with"),
        F.count_if(F.col(dist).isNull()).alias("n_without"),
        F.avg(dist).alias("dist_mean"),
        F.avg(ratio).alias("ratio_mean"),
    )
    stacked = profiles.select(
        F.stack(F.lit(2), F.lit("dist"), F.col(dist), F.lit("ratio"), F.col(ratio)).alias("feature", "value"))
    medians = median_of(stacked, ["feature"], "value").agg(
        F.max(F.when(F.col("feature") == "dist", F.col("median"))).alias("dist_median"),
        F.max(F.when(F.col("feature") == "ratio", F.col("median"))).alias("ratio_median"),
    )
    # one row each
    return counts.withColumn("_one", F.lit(1)).join(medians.withColumn("_one", F.lit(1)), "_one").drop("_one")
