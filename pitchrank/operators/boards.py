"""Leaderboards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchrank.functions.codes import round_even
from pitchrank.params import SCORE

BOARD_COLUMNS = ("player_name", "pitcher", "season", "pitch_type", "pitch_group", "n_pitches")
# Equal scores are ordered by pitcher and type, so that a board is the same every time.
_TIES = ("pitcher", "pitch_type")


def board_rows(df: DataFrame, min_pitches: int = 50, group: str | None = None,
               pitch_type: str | None = None, score: str = SCORE) -> DataFrame:
    """Scored rows with enough pitches, rounded; a type, if given, outranks a group."""
    if pitch_type:
        df = df.where(F.col("pitch_type") == pitch_type)
    elif group:
        df = df.where(F.col("pitch_group") == group)
    df = df.where(F.col(score).isNotNull())
    if "n_pitches" in df.columns:
        df = df.where(F.col("n_pitches") >= min_pitches)
    shown = [c for c in BOARD_COLUMNS if c in df.columns]
    return df.select(*shown, round_even(F.col(score), 1).alias(score))


def leaderboard(df: DataFrame, min_pitches: int = 50, group: str | None = None,
                pitch_type: str | None = None, score: str = SCORE) -> DataFrame:
    """One leaderboard, best first."""
    return board_rows(df, min_pitches, group, pitch_type, score).orderBy(F.desc(score), *_TIES)


def leaderboards_by(df: DataFrame, column: str, min_pitches: int = 50, score: str = SCORE) -> DataFrame:
    """The leaderboards of every type (or group) at once, one after the other.

    A single range-partitioned sort, so a type with most of the rows is spread too.
    """
    return (board_rows(df, min_pitches, score=score)
            .where(F.col(column).isNotNull()).orderBy(column, F.desc(score), *_TIES))


def top(board: DataFrame, n: int = 20) -> DataFrame:
    return board.limit(n)


def most_recent(df: DataFrame) -> DataFrame:
    """Rows of the latest season."""
    return df.where(F.col("season") == df.select(F.max("season")).scalar())


def career(df: DataFrame, score: str = SCORE) -> DataFrame:
    """Pitch-weighted mean score over all seasons, best first.

    The mean is over scored rows; ``total_pitches`` counts all rows.
    """
    weight = F.when(F.col(score).isNotNull(), F.col("n_pitches"))
    sums = df.dropna(subset=["pitcher", "player_name", "pitch_type"]).groupBy(
        "pitcher", "player_name", "pitch_type",
    ).agg(
        F.sum(F.col(score) * F.col("n_pitches")).alias("_weighted"),
        F.sum(weight).alias("_scored"),
        F.sum("n_pitches").alias("total_pitches"),
    )
    mean = F.try_divide(F.col("_weighted"), F.col("_scored"))
    return (
        sums.where(F.col("_scored").isNotNull())
        .select("pitcher", "player_name", "pitch_type",
                round_even(mean, 1).alias(f"{score}_career"), "total_pitches")
        .orderBy(F.desc(f"{score}_career"), "pitcher", "pitch_type")
    )
