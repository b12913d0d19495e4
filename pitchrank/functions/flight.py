"""Pitch flight under constant acceleration, as column expressions.

Distances are feet from the back of the plate, so a pitch flies toward smaller y
with negative ``vy``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pitchrank import params as P
from pitchrank.functions.codes import clip


def speed_at(vy: Column, ay: Column, y_from: Column, y_to: float) -> Column:
    """Speed toward the plate once the ball has reached ``y_to``."""
    return F.sqrt(clip(vy * vy + F.lit(2.0) * ay * (F.lit(y_to) - y_from), low=0.0))


def time_to(vy: Column, ay: Column, y_from: Column, y_to: float) -> Column:
    """Time of the first crossing of ``y_to``; null without acceleration."""
    return F.try_divide(-vy - speed_at(vy, ay, y_from, y_to), ay)


def position_after(t: Column, start: Column, v: Column, a: Column) -> Column:
    return start + v * t + F.lit(0.5) * a * t * t


def approach_angle(v: Column, a: Column, t: Column, along: Column) -> Column:
    """Angle in degrees between the flight and the y axis after time ``t``.

    ``v`` and ``a`` are the vertical or the horizontal component, ``along`` the
    speed toward the plate.
    """
    across = v + a * t
    return F.when((across != 0) | (along > 0), F.degrees(F.atan2(across, along)))


def spin_efficiency(pfx_x: Column, pfx_z: Column, speed: Column, spin: Column, axis: Column,
                    pfx_scale: float = 1.0) -> Column:
    """Share of the spin that moves the ball: movement along the spin's own direction
    over the movement that full spin would give."""
    angle = F.radians(axis)
    along = pfx_x * F.sin(angle) - pfx_z * F.cos(angle)
    if pfx_scale != 1.0:
        along = along * F.lit(pfx_scale)
    full = (
        spin / F.lit(P.SPIN_REFERENCE_RPM)
        * (speed / F.lit(P.SPIN_REFERENCE_MPH))
        * F.lit(P.SPIN_REFERENCE_INCHES)
    )
    low, high = P.SPIN_EFFICIENCY_BOUNDS
    return clip(along / clip(full, low=P.SPIN_MIN_MOVEMENT), low, high)


def arm_side_break(pfx_x: Column, hand: Column) -> Column:
    """Horizontal break signed so that the arm side is positive."""
    return F.when(hand == "R", -pfx_x).otherwise(pfx_x)
