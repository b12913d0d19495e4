"""Reading and writing tables."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchrank.params import DEFAULTS, FASTBALLS, MODEL_TYPES, SCORE, Settings
from pitchrank.schema import PITCH_SCHEMA
from pitchrank.sources.versions import has_commits, month_folders, read_manifest

CODECS = ("snappy", "zstd", "gzip", "none")
PITCH_CODES = tuple(sorted({*FASTBALLS, *MODEL_TYPES}))


STORE_SCHEMA = T.StructType([*PITCH_SCHEMA.fields, T.StructField("season", T.IntegerType()),
                             T.StructField("month", T.IntegerType())])


def read_store(spark: SparkSession, root: str) -> DataFrame:
    """The stored pitch table by its declared schema: a column that a file lacks is null there.

    Of a store with a manifest, the months it lists as of now, each in its visible version;
    a store without one is read as it lies there.
    """
    if not has_commits(spark, root):
        return read_table(spark, root, schema=STORE_SCHEMA)
    folders = month_folders(read_manifest(spark, root), root)
    if not folders:
        return spark.createDataFrame([], STORE_SCHEMA)
    versioned = T.StructType([*STORE_SCHEMA.fields, T.StructField("version", T.StringType())])
    return spark.read.schema(versioned).option("basePath", root).parquet(*folders).drop("version")


def read_table(spark: SparkSession, path: str, columns=None, schema: T.StructType | None = None) -> DataFrame:
    """A Parquet table, or some of its columns (those that exist).

    Without ``schema`` the columns are those of one of its files.
    """
    try:
        df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"no table at {path}: run the step that writes it first") from e
    return df if columns is None else df.select([c for c in columns if c in df.columns])


def write_table(df: DataFrame, path: str, codec: str = "snappy", partition_by=(),
                mode: str = "overwrite", overwrite: str = "static", order=None, bloom=(), page_rows: int | None = None) -> None:
    """Write a Parquet table.

    A partitioned write is first rebalanced on the partition columns: small
    partitions share tasks, and one that holds much of the data is split over
    several tasks and files. Rows are put into ``order`` (a column) within each file, so
    that readers skip pages by their bounds; ``bloom`` columns get a filter per row group,
    and ``page_rows`` bounds a page.
    """
    if codec not in CODECS:
        raise ValueError(f"codec must be one of {', '.join(CODECS)}")
    out = df
    if partition_by:
        out = df.hint("rebalance", *[F.col(c) for c in partition_by])
    if order is not None:
        out = out.withColumn("_order", order).sortWithinPartitions(*partition_by, "_order").drop("_order")
    writer = (out.write.mode(mode).option("compression", codec)
                 .option("partitionOverwriteMode", overwrite))
    for c in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    if page_rows:
        writer = writer.option("parquet.page.row.count.limit", page_rows)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def interleaved(*ranks, bits: int = 8):
    """One key from several whole numbers of ``bits`` bits, taking a bit of each in turn, the highest first.

    Rows close in this key are close in every number, so files in its order can be skipped by
    any of them.
    """
    key = F.lit(0).cast("long")
    for bit in range(bits):
        for n, rank in enumerate(ranks):
            one = F.shiftright(rank.cast("long"), bit).bitwiseAND(F.lit(1))
            key = key + F.shiftleft(one, bit * len(ranks) + len(ranks) - 1 - n)
    return key


def by_pitcher_and_type(pitches: DataFrame, types=PITCH_CODES):
    """The order in which both one pitcher's and one type's pitches lie together.

    Reads the least and the largest pitcher once. Pitchers fall into 256 even ranges, types
    into places of the sorted ``types``; unknown ones come last.
    """
    low, high = pitches.agg(F.min("pitcher"), F.max("pitcher")).first()
    if low is None:
        return F.lit(0)
    place = F.floor((F.col("pitcher") - low) * 255 / max(high - low, 1))
    names = sorted(types)
    known = F.array_position(F.array(*[F.lit(t) for t in names]), F.col("pitch_type"))
    kind = F.floor((F.when(known > 0, known - 1).otherwise(len(names))) * 255 / len(names))
    return interleaved(F.coalesce(place, F.lit(255)), F.coalesce(kind, F.lit(255)))


def rows_scanned(df: DataFrame) -> int:
    """Rows that the scans of a plan without a shuffle hand on after skipping row groups and pages; runs it once."""
    execution = df._jdf.queryExecution()
    execution.toRdd().count()
    leaves = execution.executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


BUCKET_ROWS = 250_000  # in a bucket, if keys fill them evenly


def buckets_for(df: DataFrame, least: int = 8) -> int:
    """Buckets for the rows of ``df``, which are counted; their number grows with the table and their size does not."""
    return max(least, -(-df.count() // BUCKET_ROWS))


def write_bucketed(df: DataFrame, table: str, path: str, buckets: int, by="pitcher", sort=("pitch_type",)) -> DataFrame:
    """Store pitches dealt to ``buckets`` by pitcher, each bucket one sorted file, and return the table.

    Whatever is grouped or joined by keys that include the pitcher then finds its rows in
    one place: counts, fastball means and profiles need no shuffle. A pitcher's rows lie in
    one bucket, so the busiest one bounds how even the tasks are; where a few hold much of a
    table, deal by several columns (``by``), as pitcher and season: what is grouped by both needs
    no shuffle then, and a bucket holds seasons of a pitcher instead of a career. The table is
    known to this session; ``open_bucketed`` makes the folder known to another.
    """
    by = _columns(by)
    (df.repartition(buckets, *by).write.mode("overwrite").option("path", path)
       .bucketBy(buckets, *by).sortBy(*by, *sort).saveAsTable(table))
    return df.sparkSession.table(table)


def _columns(by) -> tuple[str, ...]:
    return (by,) if isinstance(by, str) else tuple(by)


def open_bucketed(spark: SparkSession, table: str, path: str, buckets: int, schema: T.StructType,
                  by="pitcher", sort=("pitch_type",)) -> DataFrame:
    """A folder that ``write_bucketed`` has filled, as a table of this session."""
    by = _columns(by)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    clustered, order = (", ".join(f"`{c}`" for c in names) for names in (by, (*by, *sort)))
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet CLUSTERED BY ({clustered}) "
              f"SORTED BY ({order}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(table)


def load_seasons(spark: SparkSession, root: str, seasons=None, include_current: bool = False,
                 columns=None, settings: Settings = DEFAULTS) -> DataFrame:
    """Chosen seasons of the stored pitch table; only their folders and columns are read.

    A season listed twice, or listed and also current, is read once. A season that is not
    stored is an error, which names it. The declared columns come back for every season,
    null where a season was stored without one.
    """
    wanted = set(settings.train_seasons if seasons is None else seasons)
    if include_current:
        wanted.add(settings.current_season)
    df = read_store(spark, root)
    if has_commits(spark, root):
        stored = {r["season"] for r in read_manifest(spark, root).select("season").distinct().collect()}
        absent = sorted(wanted - stored)
    else:
        absent = [s for s in sorted(wanted) if not _is_stored(spark, f"{root.rstrip('/')}/season={s}")]
    if absent:
        raise FileNotFoundError(f"not stored under {root}: season {', '.join(map(str, absent))}; ingest it first")
    df = df.where(F.col("season").isin(sorted(wanted)))
    return df if columns is None else df.select([c for c in columns if c in df.columns])


def _is_stored(spark: SparkSession, path: str) -> bool:
    """Whether there is a folder of that name; its files are not opened."""
    try:
        spark.read.schema(STORE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def union_tables(*tables: DataFrame) -> DataFrame:
    """All rows of all tables by column name; columns a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def _changed_at(spark: SparkSession, path: str, suffix: str):
    """Latest modification time of the files under ``path``; contents are not read."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}")
             .option("recursiveFileLookup", "true").load(path))
    return files.agg(F.max("modificationTime")).first()[0]


def read_csv_cached(spark: SparkSession, csv_path: str, cache_path: str | None = None,
                    schema: T.StructType | str | None = None, **options) -> DataFrame:
    """A CSV table through a Parquet copy, renewed whenever the CSV is not older than the copy.

    Without ``schema`` the types are inferred, which reads the CSV twice.
    """
    cache_path = cache_path or f"{csv_path.removesuffix('.csv')}.parquet"
    try:
        copied = _changed_at(spark, cache_path, ".parquet")
    except AnalysisException:
        copied = None
    if copied is None or copied <= _changed_at(spark, csv_path, ""):
        reader = spark.read.options(header=True, **options)
        reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
        reader.csv(csv_path).write.mode("overwrite").parquet(cache_path)
    return spark.read.parquet(cache_path)


def save_board(board: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Write an ordered table as CSV with a header.

    The part files continue each other in order; a small board comes out as one
    file, a large one is never squeezed through one task.
    """
    writer = board.write.mode("overwrite").option("header", True)
    (writer.partitionBy(partition_by) if partition_by else writer).csv(path)


def read_board(spark: SparkSession, path: str, score: str = SCORE) -> DataFrame:
    """A saved leaderboard."""
    return spark.read.option("header", True).schema(
        "player_name string, pitcher long, season int, pitch_type string, pitch_group string, "
        f"n_pitches long, {score} double").csv(path)
