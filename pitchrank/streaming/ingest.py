"""Following a landing area with Structured Streaming.

Deliveries land as ``<landing>/delivery=<id>/*.parquet``; ids grow, and a delivery holds
whole months. The stream of files tells which months have changed: each of them is then
replaced by the latest delivery that holds it. So it does not matter how files fall into
micro-batches, and a batch that is repeated after a failure writes the same months again.

A delivery is over when its mark lies in ``<landing>_marks``. A second stream follows the
marks. Which deliveries have brought rows of which month, and which are over, is kept
beside the checkpoints, one folder a batch, so that a repeated batch overwrites itself. A
month closes when the calendar has passed it and the latest delivery that holds it is
over, whether or not new files have come. Rows that land for a closed month go to a side
table.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchrank.schema import PITCH_SCHEMA
from pitchrank.sources.landing import PARTS, close_months, day_of, month_first, replace_months
from pitchrank.sources.versions import read_manifest

DELIVERY = "delivery"
MARKS = f"{DELIVERY} long"
TAKEN = f"season int, month int, {DELIVERY} long, rows long, late boolean"


def _landing_schema(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(DELIVERY, T.LongType())])


def latest_months(landing: DataFrame, months: list[date], since: int) -> DataFrame:
    """Landing rows of the given months (first days), each from its latest delivery.

    No delivery before ``since`` can be the latest of these months, so only the
    folders from there on are read, and of those only the blocks that may hold the
    months.
    """
    day = day_of(landing)
    span = day.between(F.lit(min(months)), F.last_day(F.lit(max(months))))
    rows = landing.where((F.col(DELIVERY) >= since) & span).withColumn("_first", F.trunc(day, "MM")).where(
        F.col("_first").isin(months))
    # one row per touched month
    latest = rows.groupBy("_first").agg(F.max(DELIVERY).alias(DELIVERY))
    return rows.join(F.broadcast(latest), ["_first", DELIVERY], "left_semi").drop("_first", DELIVERY)


def finish_deliveries(spark: SparkSession, landing: str, *deliveries: int) -> None:
    """Mark deliveries as over: nothing more of them will land. Marking one again changes nothing."""
    rows = [(int(d),) for d in deliveries]
    spark.createDataFrame(rows, MARKS).coalesce(1).write.mode("append").parquet(f"{landing.rstrip('/')}_marks")


def _state(spark: SparkSession, checkpoint: str, name: str, schema) -> DataFrame:
    """All batches of a state table; empty before the first."""
    path = f"{checkpoint.rstrip('/')}/months/{name}"
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/batch=-1")
    return spark.read.schema(schema).parquet(path).drop("batch")


def _keep(rows: DataFrame, checkpoint: str, name: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{checkpoint.rstrip('/')}/months/{name}/batch={batch_id}")


def month_states(spark: SparkSession, root: str, checkpoint: str) -> DataFrame:
    """One row per month that deliveries have brought.

    ``latest`` is the latest delivery taken in, ``open_deliveries`` those after the last one
    that is over, ``late_rows`` the rows in the side table; ``rows`` and ``is_complete`` are
    the store's, null and false for a month that is not stored.
    """
    taken = _state(spark, checkpoint, "taken", TAKEN)
    over = _state(spark, checkpoint, "over", MARKS).distinct().withColumn("_over", F.lit(True))
    # a few rows a month and delivery
    known = taken.groupBy(*PARTS, DELIVERY, "late").agg(F.sum("rows").alias("_rows")).join(over, DELIVERY, "left")
    held, done = ~F.col("late"), F.col("_over").isNotNull()
    months = known.groupBy(*PARTS).agg(
        F.max(F.when(held, F.col(DELIVERY))).alias("latest"),
        F.coalesce(F.max(F.when(held & done, F.col(DELIVERY))), F.lit(-1)).alias("_last_over"),
        F.collect_set(F.when(held & ~done, F.col(DELIVERY))).alias("_open"),
        F.coalesce(F.sum(F.when(~held, F.col("_rows"))), F.lit(0)).alias("late_rows"))
    stored = read_manifest(spark, root).select(*PARTS, "rows", "is_complete")
    return months.join(stored, list(PARTS), "left").select(
        *PARTS, "latest", F.size(F.filter("_open", lambda d: d > F.col("_last_over"))).alias("open_deliveries"),
        "late_rows", "rows", F.coalesce("is_complete", F.lit(False)).alias("is_complete"))


def late_rows(spark: SparkSession, checkpoint: str, schema: T.StructType = PITCH_SCHEMA) -> DataFrame:
    """Rows that landed for months that were closed, with their delivery."""
    return _state(spark, checkpoint, "late", _landing_schema(schema))


def follow_landing(spark: SparkSession, landing: str, root: str, checkpoint: str,
                   today: date | None = None, force: bool = False, files_per_batch: int | None = None,
                   schema: T.StructType = PITCH_SCHEMA, finished=()) -> None:
    """Take in everything that has landed since the last call, and close the months that can be.

    ``finished`` deliveries are marked first (as by ``finish_deliveries``). Marks are read
    before files, so all files of a delivery that counts as over are taken in before its
    months close. Rows of closed months go to the side table unless ``force``, which
    replaces such months and opens them again. Schedule it.
    """
    today = today or date.today()
    with_delivery = _landing_schema(schema)
    finish_deliveries(spark, landing, *finished)  # also makes the folder

    def note(batch: DataFrame, batch_id: int) -> None:
        _keep(batch.distinct(), checkpoint, "over", batch_id)

    marks = spark.readStream.schema(MARKS).parquet(f"{landing.rstrip('/')}_marks")
    _drain(marks, note, f"{checkpoint}/marks")

    def take(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        rows = batch.withColumn("_first", F.trunc(day_of(batch), "MM")).dropna(subset=["_first"])
        closed = read_manifest(session, root).where(F.lit(not force) & F.col("is_complete")).select(
            month_first().alias("_first"), F.lit(True).alias("late"))
        # calendar months and their deliveries: a short list however much has landed
        found = rows.groupBy("_first", DELIVERY).agg(F.count(F.lit(1)).alias("rows")).join(
            F.broadcast(closed), "_first", "left").collect()
        noted = [(r["_first"].year, r["_first"].month, r[DELIVERY], r["rows"], bool(r["late"])) for r in found]
        late = sorted({r["_first"] for r in found if r["late"]})
        months = sorted({r["_first"] for r in found if not r["late"]})
        if late:
            _keep(rows.where(F.col("_first").isin(late)).drop("_first"), checkpoint, "late", batch_id)
        if months:
            stored = session.read.schema(with_delivery).parquet(landing)
            since = min(r[DELIVERY] for r in found if not r["late"])
            replace_months(session, latest_months(stored, months, since), root, today, may_close=False)
        _keep(session.createDataFrame(noted, TAKEN), checkpoint, "taken", batch_id)

    source = spark.readStream.schema(with_delivery)
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    _drain(source.parquet(landing), take, f"{checkpoint}/files")

    passed = month_first() < F.lit(today.replace(day=1))
    ready = month_states(spark, root, checkpoint).where(
        (F.col("open_deliveries") == 0) & ~F.col("is_complete") & F.col("rows").isNotNull() & passed)
    months = [tuple(r) for r in ready.select(*PARTS).collect()]  # calendar months
    if months:
        close_months(spark, root, spark.createDataFrame(months, "season int, month int"))


def _drain(stream: DataFrame, batch, checkpoint: str) -> None:
    """Hand over everything that has come, batch by batch."""
    (stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())
