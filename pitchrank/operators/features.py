"""Physics columns per pitch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchrank import params as P
from pitchrank.functions import codes, flight
from pitchrank.operators.clean import SEASON_KEY
from pitchrank.operators.joins import lookup_join
from pitchrank.params import DEFAULTS, Settings


_FLIGHT = ("_t_tunnel", "_t_plate", "_v_plate")


def with_flight(df: DataFrame) -> DataFrame:
    """Times of flight and the speed at the plate, which several features share.

    Kept as columns of their own: written out inside every feature they would be
    computed, and compiled, many times over.
    """
    if not {"vy0", "ay", "release_pos_y"} <= set(df.columns):
        return df.withColumns({c: F.lit(None).cast("double") for c in _FLIGHT})
    y = [F.col("vy0"), F.col("ay"), F.col("release_pos_y")]
    return df.withColumns({
        "_t_tunnel": flight.time_to(*y, P.TUNNEL_Y),
        "_t_plate": flight.time_to(*y, P.PLATE_Y),
        "_v_plate": flight.speed_at(*y, P.PLATE_Y),
    })


def _angle(df: DataFrame, axis: str):
    if not {f"v{axis}0", f"a{axis}"} <= set(df.columns):
        return F.lit(None).cast("double")
    return flight.approach_angle(
        F.col(f"v{axis}0"), F.col(f"a{axis}"), F.col("_t_plate"), F.col("_v_plate"))


def tunnel_columns(df: DataFrame) -> dict:
    """Positions at the decision point and at the plate; null if an input column is absent."""
    needed = {"vx0", "vy0", "vz0", "ax", "ay", "az", "release_pos_x", "release_pos_y", "release_pos_z"}
    if not needed <= set(df.columns):
        return {c: F.lit(None).cast("double") for c in P.TUNNEL_POSITIONS}
    side = [F.col("release_pos_x"), F.col("vx0"), F.col("ax")]
    height = [F.col("release_pos_z"), F.col("vz0"), F.col("az")]
    tunnel, plate = (codes.clip(F.col(t), low=0.0) for t in ("_t_tunnel", "_t_plate"))
    return {
        "tunnel_x": flight.position_after(tunnel, *side),
        "tunnel_z": flight.position_after(tunnel, *height),
        "plate_x_kin": flight.position_after(plate, *side),
        "plate_z_kin": flight.position_after(plate, *height),
    }


def spin_column(df: DataFrame, settings: Settings = DEFAULTS):
    needed = ["pfx_x", "pfx_z", "release_speed", "release_spin_rate", "spin_axis"]
    if not set(needed) <= set(df.columns):
        return F.lit(None).cast("double")
    return flight.spin_efficiency(*[F.col(c) for c in needed], pfx_scale=settings.pfx_scale)


def add_tunnel_positions(df: DataFrame) -> DataFrame:
    return with_flight(df).withColumns(tunnel_columns(df)).drop(*_FLIGHT)


def add_spin_efficiency(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    return df.withColumn("spin_efficiency", spin_column(df, settings))


def add_physics(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Every feature that needs nothing but its own row, in one projection."""
    arm = (
        flight.arm_side_break(F.col("pfx_x"), F.col("p_throws"))
        if "p_throws" in df.columns else F.col("pfx_x")
    )
    out = with_flight(df).withColumns({
        "induced_vertical_break": F.col("pfx_z"),
        "horz_break": F.col("pfx_x"),
        "arm_side_break": arm,
        "vaa": _angle(df, "z"),
        "haa": _angle(df, "x"),
        "spin_efficiency": spin_column(df, settings),
        **tunnel_columns(df),
    }).drop(*_FLIGHT)
    if "p_throws_enc" not in df.columns and "p_throws" in df.columns:
        out = out.withColumn("p_throws_enc", codes.hand_flag(F.col("p_throws")))
    return out


def is_fastball():
    return F.col("pitch_type").isin(*P.FASTBALLS)


def speed_gap(fastball_speed, speed):
    """How much slower than the fastball; 0 if faster or if there is no fastball."""
    return F.greatest(F.coalesce(fastball_speed - speed, F.lit(0.0)), F.lit(0.0))


def add_speed_diff(df: DataFrame) -> DataFrame:
    """Speed below the mean fastball of the same pitcher and season.

    Without a usable date the mean is over all of the pitcher's seasons.
    """
    dated = "game_date" in df.columns and isinstance(
        df.schema["game_date"].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
    rows = df.withColumn(SEASON_KEY, F.year("game_date")) if dated else df
    keys = ["pitcher", SEASON_KEY] if dated else ["pitcher"]
    fastballs = rows.dropna(subset=keys).groupBy(*keys).agg(
        F.avg(F.when(is_fastball(), F.col("release_speed"))).alias("_fastball"),
        F.count(F.lit(1)).alias("_rows"),
    )
    return (
        lookup_join(rows, fastballs, keys, "_rows")
        .withColumn("speed_diff", speed_gap(F.col("_fastball"), F.col("release_speed")))
        .drop("_fastball", SEASON_KEY)
    )


def build_features(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Clean pitches with all physics columns."""
    return df.transform(add_physics, settings).transform(add_speed_diff)
