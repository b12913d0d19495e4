"""Keeping the stored pitch table up to date from a landing area.

Months are written to versioned folders and become visible with one commit of the
manifest (``sources.versions``). A month is always replaced as a whole, so repeating a
delivery changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchrank.functions.codes import round_even
from pitchrank.params import DEFAULTS, Settings
from pitchrank.schema import MANIFEST_SCHEMA, PITCH_SCHEMA, as_pitches, game_day
from pitchrank.sources.calendar import season_months, season_range
from pitchrank.sources.tables import STORE_SCHEMA, by_pitcher_and_type, read_store, write_table
from pitchrank.sources.versions import commit, new_version, read_manifest

PARTS = ("season", "month")


def by_month(df: DataFrame) -> DataFrame:
    """Pitches in the declared schema with their season and month."""
    return as_pitches(df).where(F.col("game_date").isNotNull()).withColumns(
        {"season": F.year("game_date"), "month": F.month("game_date")})


def month_first(season="season", month="month"):
    return F.make_date(F.col(season), F.col(month), F.lit(1))


def measure(stored: DataFrame) -> DataFrame:
    """Rows and bytes per stored month, from the files that hold them."""
    files = (
        stored.select(*PARTS, "_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
        .groupBy(*PARTS, "file_path", "file_size", "file_modification_time")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    return files.groupBy(*PARTS).agg(
        F.sum("rows").alias("rows"), F.sum("file_size").alias("size_bytes"),
        F.max("file_modification_time").alias("fetched_at"))


@dataclass
class Staged:
    """Months that are written but not visible yet."""

    root: str
    version: str
    rows: list  # a manifest row for each month; those of months that are stored already are as they were


def fingerprints(monthly: DataFrame) -> DataFrame:
    """(season, month, fingerprint) of what the months hold, whatever the order or the files of its rows.

    The sum of a hash of each row, with the number of rows; the hash knows which column a
    value or a null stands in, and an absent column is one of nulls.
    """
    values = [F.xxhash64(F.lit(n), F.col(f.name) if f.name in monthly.columns else F.lit(None).cast(f.dataType))
              for n, f in enumerate(PITCH_SCHEMA)]
    # summed up in three parts of 21 or 22 bits each, as sums of wide decimals are slow
    row = F.xxhash64(*values)
    parts = [F.shiftright(row, 42), F.shiftright(row, 21).bitwiseAND(F.lit((1 << 21) - 1)), row.bitwiseAND(F.lit((1 << 21) - 1))]
    high, middle, low = (F.sum(p).cast("decimal(20,0)") for p in parts)
    total = ((high * F.lit(1 << 21) + middle) * F.lit(1 << 21) + low).cast("decimal(38,0)")
    return monthly.groupBy(*PARTS).agg(F.concat_ws(":", F.count(F.lit(1)), total.cast("string")).alias("fingerprint"))


def stage_months(spark: SparkSession, rows: DataFrame, root: str, codec: str = "snappy", skip_same: bool = True,
                 clustered: bool = False, page_rows: int | None = None) -> Staged:
    """Write the months that ``rows`` holds to folders of a new version; readers see nothing of it.

    Unless ``skip_same`` is off, ``rows`` are first read for their fingerprints, and months
    that are stored just so already are not written again.
    """
    version, monthly = new_version(), by_month(rows)
    prints, same = {}, []
    if skip_same:
        found = fingerprints(monthly).collect()  # one row per month, as below
        prints = {(r["season"], r["month"]): r["fingerprint"] for r in found}
        stored = [r.asDict() for r in read_manifest(spark, root).where("fingerprint IS NOT NULL").collect()]
        same = [r for r in stored if prints.get((r["season"], r["month"])) == r["fingerprint"]]
        if len(same) == len(prints):
            return Staged(root, version, same)
        for r in same:
            monthly = monthly.where((F.col("season") != r["season"]) | (F.col("month") != r["month"]))
    layout = {"order": by_pitcher_and_type(monthly), "bloom": ["pitcher"], "page_rows": page_rows} if clustered else {}
    write_table(monthly.withColumn("version", F.lit(version)), root, codec, [*PARTS, "version"], mode="append", **layout)
    versioned = T.StructType([*STORE_SCHEMA.fields, T.StructField("version", T.StringType())])
    try:
        written = (spark.read.schema(versioned).option("basePath", root)
                   .parquet(f"{root.rstrip('/')}/season=*/month=*/version={version}"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return Staged(root, version, same)  # there were no rows
    new = [{**r.asDict(), "version": version, "fingerprint": prints.get((r["season"], r["month"]))}
           for r in measure(written).collect()]
    return Staged(root, version, [*same, *new])


def commit_months(spark: SparkSession, staged: Staged, is_complete, drop_season: int | None = None) -> None:
    """Make staged months visible in place of the former ones, all at once.

    ``is_complete`` is a condition on season and month. Other months of ``drop_season`` go.
    """
    if not staged.rows:
        return
    found = [{**r, "is_complete": None} for r in staged.rows]
    new = spark.createDataFrame([tuple(r[f] for f in MANIFEST_SCHEMA.fieldNames()) for r in found], MANIFEST_SCHEMA)
    new = new.withColumn("is_complete", is_complete)

    def change(old: DataFrame) -> DataFrame:
        kept = old if drop_season is None else old.where(F.col("season") != drop_season)
        return kept.join(new.select(*PARTS), list(PARTS), "left_anti").unionByName(new)

    commit(spark, staged.root, change)


def close_months(spark: SparkSession, root: str, months: DataFrame) -> None:
    """Mark the listed months (season, month) complete, in one commit."""
    def change(old: DataFrame) -> DataFrame:
        done = months.select(*PARTS).distinct().withColumn("_done", F.lit(True))
        return old.join(done, list(PARTS), "left").withColumn("is_complete", F.col("is_complete") | F.col("_done").isNotNull())

    commit(spark, root, change)


def _stored(spark: SparkSession, root: str, season: int) -> DataFrame:
    return read_store(spark, root).where(F.col("season") == season)


def day_of(landing: DataFrame):
    """Calendar day of the landing rows, whatever type the date landed as; the bare column for a date."""
    return game_day(F.col("game_date"), landing.schema["game_date"].dataType)


def ingest_season(spark: SparkSession, landing: DataFrame, root: str, season: int,
                  force: bool = False, today: date | None = None, codec: str = "snappy") -> DataFrame:
    """Store one season once and return it.

    A season whose manifest says complete is returned as stored, unless ``force``.
    Otherwise it is replaced by what the landing area holds within the season's
    dates; if that is nothing, the store is left alone. A past season is complete.
    """
    today = today or date.today()
    known = read_manifest(spark, root).where(F.col("season") == season)
    state = known.agg(F.count(F.lit(1)), F.min(F.col("is_complete").cast("int"))).first()
    if state[0] and state[1] == 1 and not force:
        return _stored(spark, root, season)

    start, end = season_range(season)
    rows = by_month(landing.where(day_of(landing).between(F.lit(start), F.lit(end))))
    staged = stage_months(spark, rows, root, codec)
    if not staged.rows:
        return rows
    commit_months(spark, staged, F.lit(season < today.year), drop_season=season)
    return _stored(spark, root, season)


def refresh_months(spark: SparkSession, landing: DataFrame, root: str, season: int | None = None,
                   today: date | None = None, force: bool = False, codec: str = "snappy",
                   settings: Settings = DEFAULTS) -> DataFrame:
    """Bring the open season up to today, month by month, in one job; return the season.

    Complete months are not read again (``force`` does); the others are replaced by
    what the landing area now holds. A month without rows stays as it was, and a month is complete
    once the calendar has passed it.
    """
    season = season or settings.current_season
    today = today or date.today()
    closed = set()
    if not force:
        # at most twelve rows
        closed = {r["month"] for r in read_manifest(spark, root)
                  .where((F.col("season") == season) & F.col("is_complete")).select("month").collect()}
    spans = [(first, last) for first, last in season_months(season, today)
             if first.year == season and first.month not in closed]
    if spans:
        day = day_of(landing)
        wanted = F.lit(False)
        for first, last in spans:
            wanted = wanted | day.between(F.lit(first), F.lit(last))
        replace_months(spark, landing.where(wanted), root, today, codec)
    try:
        return _stored(spark, root, season)
    except FileNotFoundError:
        return by_month(landing).limit(0)


def replace_months(spark: SparkSession, rows: DataFrame, root: str, today: date,
                   codec: str = "snappy", may_close: bool = True, **layout) -> None:
    """Replace every month that ``rows`` holds, and its manifest row, in one commit.

    ``rows`` are read once. Months the calendar has passed are complete, unless
    ``may_close`` is false. ``layout`` is that of ``stage_months``.
    """
    passed = month_first() < F.lit(today.replace(day=1))
    commit_months(spark, stage_months(spark, rows, root, codec, **layout), passed if may_close else F.lit(False))


def cache_summary(manifest: DataFrame) -> DataFrame:
    """The manifest for reading: one line per stored month, sizes in megabytes, in order."""
    return manifest.select(
        F.format_string("season=%d/month=%d", "season", "month").alias("file"),
        "season", "month", "rows",
        round_even(F.col("size_bytes") / F.lit(1e6), 1).alias("size_mb"),
        F.col("is_complete").alias("complete"), "fetched_at",
    ).orderBy("season", "month")
