"""Session set-up and the written intermediate tables that cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

# Long projections and wide aggregates generate methods the JVM will not compile
# once they pass 8000 bytes; run interpreted they are about ten times slower than
# the operator-by-operator code Spark falls back to under this limit.
METHOD_LIMIT = {"spark.sql.codegen.hugeMethodLimit": "8000"}

SESSION_CONF = {
    **METHOD_LIMIT,
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Parquet written by pandas keeps nanosecond timestamps, which Spark can only
    # read as longs; see schema.game_day.
    "spark.sql.legacy.parquet.nanosAsLong": "true",
}


def build_session(app: str = "pitchrank", master: str | None = None, **conf) -> SparkSession:
    """Session with the settings the operators expect; master and resources stay the cluster's."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Set on a foreign session what the plans need at run time."""
    for key, value in METHOD_LIMIT.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor reaches, as named by ``spark.checkpoint.dir``.

    A local session without that setting gets a folder of its own; a cluster
    without it is refused, since a machine-local folder would lose rows there.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if configured:
        if current is None:
            context.setCheckpointDir(configured)
        return configured.rstrip("/")
    if current is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="pitchrank-"))
        current = context.getCheckpointDir()
    return current.rstrip("/")


_SCRATCH: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's folder within the shared one.

    The application's folder goes when the driver's Python ends.
    """
    folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    if folder not in _SCRATCH:
        _SCRATCH.add(folder)
        atexit.register(_remove, spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def remove_scratch(spark: SparkSession) -> None:
    """Remove what this application has written in between; tables read from there are gone."""
    context = spark.sparkContext
    _remove(context._jvm, context._jsc.hadoopConfiguration(), f"{shared_dir(spark)}/{context.applicationId}")


def remove_table(spark: SparkSession, path: str) -> None:
    """Remove a written intermediate that nothing reads any more."""
    _remove(spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path)


def _remove(jvm, conf, folder: str) -> None:
    try:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    except (Py4JError, OSError):  # the JVM may have ended first
        pass


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once and read it back.

    Later uses read the columns they need from Parquet instead of repeating the
    work, and a lost executor costs no recomputation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
