"""A pitch-shaped view of the ``lineitem`` table.

The same expressions are given to other engines as SQL (``plans.oracles``), so the
results of every operator can be compared on shared input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TYPES = ("FF", "SI", "FC", "SL", "CU", "KC", "SV", "ST", "CH", "FS", "FO", "FT", "AB")
_EVENTS = (
    "ball", "called_strike", "swinging_strike", "foul", "hit_into_play", "blocked_ball", "foul_tip",
    "swinging_strike_blocked", "hit_by_pitch", "missed_bunt", "foul_bunt", "hit_into_play_no_out",
    "pitchout", "intent_ball", "hit_into_play_score", "foul_pitchout", "unknown_event",
)


def _pick(index, values):
    """Value at ``index``, null beyond the list."""
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def pitch_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pitches made from order lines; one row each."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    c = F.col
    h = c("l_orderkey") * 31 + c("l_partkey") * 17 + c("l_linenumber") * 7
    pitcher = F.when(c("l_suppkey") <= 5, c("l_suppkey") + 100).otherwise(c("l_suppkey") % 20)
    outcome = h % 17

    def known(divisor, value):
        return F.when(h % divisor != 0, value)

    return li.select(
        F.to_date("l_shipdate").alias("game_date"),
        c("l_orderkey").alias("game_pk"),
        pitcher.alias("pitcher"),
        F.concat(F.lit("P"), pitcher.cast("string"), F.when(h % 50 == 0, "x").otherwise("")).alias("player_name"),
        c("l_linenumber").cast("int").alias("pitch_number"),
        _pick(c("l_partkey") % 14, _TYPES).alias("pitch_type"),
        (c("l_quantity") * F.lit(0.6) + F.lit(74.0)).alias("release_speed"),
        ((c("l_discount") - F.lit(0.05)) * F.lit(20.0)).alias("pfx_x"),
        ((c("l_tax") - F.lit(0.02)) * F.lit(20.0)).alias("pfx_z"),
        known(23, (c("l_partkey") * 13 % 1900 + 1700).cast("double")).alias("release_spin_rate"),
        known(29, (c("l_partkey") * 7 % 360).cast("double")).alias("spin_axis"),
        ((c("l_orderkey") % 61 - 30) / F.lit(5.5)).alias("release_pos_x"),
        (F.lit(53.0) + c("l_linenumber") / F.lit(4.0)).alias("release_pos_y"),
        (F.lit(5.0) + c("l_partkey") % 31 / F.lit(20.0)).alias("release_pos_z"),
        (F.lit(5.5) + c("l_orderkey") % 17 / F.lit(10.0)).alias("release_extension"),
        ((c("l_orderkey") % 21 - 10) / F.lit(2.0)).alias("vx0"),
        (-(c("l_quantity") * F.lit(0.9) + F.lit(105.0))).alias("vy0"),
        (-(c("l_partkey") % 13) / F.lit(3.0)).alias("vz0"),
        (c("l_partkey") % 25 - 12).cast("double").alias("ax"),
        (c("l_orderkey") % 10 + 22).cast("double").alias("ay"),
        (c("l_linenumber") * F.lit(2.0) - F.lit(32.0)).alias("az"),
        known(11, c("l_discount") * F.lit(8.0)).alias("estimated_woba_using_speedangle"),
        _pick(outcome, _EVENTS).alias("description"),
        F.when(outcome.isin(4, 11, 14), "X").when(outcome.isin(0, 5, 8, 12, 13), "B")
        .otherwise("S").alias("type"),
        known(19, (h % 5).cast("int")).alias("balls"),
        (h % 4).cast("int").alias("strikes"),
        F.when(pitcher % 3 == 0, "L").otherwise("R").alias("p_throws"),
    )
