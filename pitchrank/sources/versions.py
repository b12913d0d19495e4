"""Months in versioned folders, made visible by commits of the manifest.

The store is Parquet under ``<root>/season=S/month=M/version=V``. Beside it,
``<root>_manifest`` holds snapshots, each a small table with one row per visible month and
the version that is visible, and ``commits``, one tiny file per commit in order, which
names a snapshot. A commit is the creation of that one file, and fails if another writer
has created it first. So a reader sees all months of a replacement or none, a failed write
leaves nothing but folders that no snapshot lists, and what a reader has begun to read
stays in place until ``remove_unlisted``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchrank.schema import MANIFEST_SCHEMA

TRIES = 20  # commits that may come in between before one gives up


def manifest_path(root: str) -> str:
    return f"{root.rstrip('/')}_manifest"


def _files(spark: SparkSession, path: str):
    """The Hadoop path and its file system, whatever store it lies in."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _latest(spark: SparkSession, root: str) -> tuple[int, str | None]:
    """Number of the last commit and the snapshot it names; 0 and none before the first."""
    at, fs = _files(spark, f"{manifest_path(root)}/commits")
    if not fs.exists(at):
        return 0, None
    # one file per commit; a file without content is being written, and not committed yet
    for number in sorted((int(s.getPath().getName()) for s in fs.listStatus(at)), reverse=True):
        path, _ = _files(spark, f"{manifest_path(root)}/commits/{number}")
        stream = fs.open(path)
        try:
            name = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        if name:
            return number, name
    return 0, None


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """One row per visible month, as of the last commit; empty before the first."""
    name = _latest(spark, root)[1]
    if name is None:
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{manifest_path(root)}/{name}")


def has_commits(spark: SparkSession, root: str) -> bool:
    return _latest(spark, root)[1] is not None


def commit(spark: SparkSession, root: str, change: Callable[[DataFrame], DataFrame]) -> None:
    """Make ``change`` of the manifest visible at once.

    If another writer commits in between, the change is made again, of that writer's manifest.
    """
    for _ in range(TRIES):
        number, name = _latest(spark, root)
        old = read_manifest(spark, root) if name is None else spark.read.schema(MANIFEST_SCHEMA).parquet(f"{manifest_path(root)}/{name}")
        snapshot = f"snapshot-{uuid.uuid4().hex}"
        change(old).select(*MANIFEST_SCHEMA.fieldNames()).coalesce(1).write.parquet(f"{manifest_path(root)}/{snapshot}")
        if _create(spark, f"{manifest_path(root)}/commits/{number + 1}", snapshot):
            return
    raise RuntimeError(f"{root}: other writers committed {TRIES} times meanwhile")


def _create(spark: SparkSession, path: str, content: str) -> bool:
    """Create a file that must not exist yet; whether it was this call that did."""
    at, fs = _files(spark, path)
    try:
        stream = fs.create(at, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    try:
        stream.write(bytearray(content.encode()))
    finally:
        stream.close()
    return True


def new_version() -> str:
    return uuid.uuid4().hex


def month_folders(manifest: DataFrame, root: str) -> list[str]:
    """Folders of the visible months, at most twelve a season."""
    return [f"{root.rstrip('/')}/season={r['season']}/month={r['month']}/version={r['version']}"
            for r in manifest.select("season", "month", "version").collect()]


def remove_unlisted(spark: SparkSession, root: str, older_than_ms: int) -> int:
    """Remove folders and snapshots that the last commit does not list and that were last changed before.

    ``older_than_ms`` is a time in milliseconds; it should lie further back than any running
    reader or writer began. Returns how many folders went.
    """
    name = _latest(spark, root)[1]
    if name is None:
        return 0
    listed = {path.split("version=")[1] for path in month_folders(read_manifest(spark, root), root)} | {name}
    gone = 0
    for pattern in (f"{root.rstrip('/')}/season=*/month=*/version=*", f"{manifest_path(root)}/snapshot-*"):
        at, fs = _files(spark, pattern)
        for status in fs.globStatus(at) or []:
            folder = status.getPath().getName().removeprefix("version=")
            if folder not in listed and status.getModificationTime() < older_than_ms:
                gone += bool(fs.delete(status.getPath(), True))
    return gone
