"""Code tables, run values and guards as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pitchrank import params as P


def _literal(value) -> str:
    return f"'{value}'" if isinstance(value, str) else f"{value!r}D"


def lookup(key: Column, table: dict) -> Column:
    """Value of ``key`` in a small fixed table, null if it has none.

    A literal map names the key once and compiles to a loop; a chain of branches
    would repeat the key, and whatever it is computed from, per branch.
    """
    pairs = ", ".join(f"{_literal(k)}, {_literal(v)}" for k, v in table.items())
    return F.expr(f"map({pairs})")[key]


def normal_code(code: Column) -> Column:
    """Pitch code with legacy codes replaced; null where the code marks no pitch."""
    renamed = {c: new for c, new in P.CODE_ALIASES.items() if new is not None}
    dropped = [c for c, new in P.CODE_ALIASES.items() if new is None]
    return F.when(~code.isin(dropped), F.coalesce(lookup(code, renamed), code))


def pitch_group(code: Column, groups=P.PITCH_GROUPS) -> Column:
    return lookup(code, {c: name for name, codes in groups.items() for c in codes})


def hand_flag(hand: Column) -> Column:
    """1 for a right-hander, 0 otherwise, unknown included."""
    return F.coalesce((hand == "R").cast("int"), F.lit(0))


def event_runs(description: Column) -> Column:
    """Fixed runs of an outcome; null for balls in play and unknown outcomes."""
    return lookup(description, P.EVENT_RUNS)


def run_value(description: Column, pitch_result: Column | None, xwoba: Column | None) -> Column:
    """Runs of one pitch before count weighting.

    A ball in play takes its expected-contact value, or 0 where that is unknown.
    Without the result column the description tells what was put in play.
    """
    in_play = description.isin(*P.IN_PLAY_EVENTS) if pitch_result is None else pitch_result == "X"
    contact = (
        F.lit(0.0) if xwoba is None
        else F.coalesce((xwoba - F.lit(P.WOBA_MEAN)) / F.lit(P.WOBA_SCALE), F.lit(0.0))
    )
    return F.when(in_play, contact).otherwise(event_runs(description))


def count_weight(balls: Column, strikes: Column) -> Column:
    """Leverage of the count; unknown counts as 0 and both parts are clipped to the table."""
    def position(c: Column, last: int) -> Column:
        return F.least(F.greatest(F.coalesce(c.cast("int"), F.lit(0)), F.lit(0)), F.lit(last))

    strike_columns = len(P.COUNT_WEIGHTS[0])
    table = F.expr(f"array({', '.join(_literal(w) for row in P.COUNT_WEIGHTS for w in row)})")
    place = position(balls, len(P.COUNT_WEIGHTS) - 1) * strike_columns
    return F.get(table, place + position(strikes, strike_columns - 1))


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bound a column; null stays null (``greatest`` alone would return the bound)."""
    bounded = c
    if low is not None:
        bounded = F.greatest(bounded, F.lit(low))
    if high is not None:
        bounded = F.least(bounded, F.lit(high))
    return F.when(c.isNotNull(), bounded)


def fast_enough(code: Column, speed: Column) -> Column:
    """Whether a pitch reaches its type's floor; types without one always do."""
    return F.coalesce(speed >= lookup(code, P.SPEED_FLOORS), F.lit(True))


def whiff(description: Column) -> Column:
    return F.coalesce(description.isin(*P.WHIFF_EVENTS), F.lit(False)).cast("double")


def called_or_whiff(description: Column) -> Column:
    codes = (*P.WHIFF_EVENTS, "called_strike")
    return F.coalesce(description.isin(*codes), F.lit(False)).cast("double")


def round_even(c: Column, digits: int) -> Column:
    """Round half to even, as array libraries do (``F.round`` rounds half up)."""
    step = 10.0**digits
    return F.rint(c * F.lit(step)) / F.lit(step)


def plus_score(raw: Column, mean: Column, sd: Column, center: Column, scale: Column) -> Column:
    """Raw run value on the plus scale: fewer runs score higher. Null if ``sd`` is 0."""
    return center - scale * F.try_divide(raw - mean, sd)
