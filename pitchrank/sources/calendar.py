"""Seasons and months as tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchrank.params import SEASON_DATES


def season_range(season: int) -> tuple[date, date]:
    """First and last day of a season."""
    if season not in SEASON_DATES:
        raise ValueError(f"season {season} has no dates; add it to SEASON_DATES")
    first, last = SEASON_DATES[season]
    return date.fromisoformat(first), date.fromisoformat(last)


def season_calendar(spark: SparkSession) -> DataFrame:
    """One row per known season."""
    rows = [(s, *season_range(s)) for s in SEASON_DATES]
    return spark.createDataFrame(rows, "season int, season_start date, season_end date")


def in_season(df: DataFrame, day: str = "game_date") -> DataFrame:
    """Rows that fall within a known season, with it.

    A season lies within its year, so the range test becomes a join on the year with
    the calendar, a fixed dozen rows.
    """
    calendar = season_calendar(df.sparkSession)
    return (
        df.drop("season").withColumn("season", F.year(day))
        .join(F.broadcast(calendar), "season")
        .where(F.col(day).between(F.col("season_start"), F.col("season_end")))
        .drop("season_start", "season_end")
    )


def month_ranges(df: DataFrame, first: Column, last: Column) -> DataFrame:
    """Explode each row into the months from ``first`` to ``last``, the last one cut off at ``last``."""
    months = F.explode(F.sequence(
        F.trunc(first, "MM"), F.trunc(last, "MM"), F.expr("interval 1 month")))
    return df.select("*", months.alias("month_start")).withColumn(
        "month_end", F.least(F.last_day("month_start"), last))


def season_months(season: int, today: date) -> list[tuple[date, date]]:
    """Months of a season up to today, as (first day, last day or today)."""
    start, _ = season_range(season)
    out = []
    year, month = start.year, start.month
    while (year, month) <= (today.year, today.month):
        following = date(year + month // 12, month % 12 + 1, 1)
        end = date.fromordinal(following.toordinal() - 1)
        out.append((date(year, month, 1), min(end, today)))
        year, month = following.year, following.month
    return out
