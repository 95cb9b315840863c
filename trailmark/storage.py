"""Intermediate tables: cut lineage by writing to the cluster's shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_local_folders: dict[str, str] = {}
_stored: dict[str, set[str]] = {}
_tables: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A local session without that setting gets a folder of its own, removed when
    Python exits. A cluster session must name one, because executors have to
    reach it after a node is lost.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", "") or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = context.applicationId
    if app not in _local_folders:
        folder = tempfile.mkdtemp(prefix="trailmark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _local_folders[app] = folder
    return _local_folders[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the scratch folder, for files an application writes and reads again."""
    return f"{scratch_folder(spark)}/{label}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writes = threading.Lock()
_writing = 0  # writes under way; the first one sets CLEANUP and the last one puts it back
_before = "false"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Writes in here delete their shuffle files when they end, not when the driver collects its garbage."""
    global _writing, _before
    with _writes:
        if not _writing:
            _before = spark.conf.get(CLEANUP, "false")
            spark.conf.set(CLEANUP, "true")
        _writing += 1
    try:
        yield
    finally:
        with _writes:
            _writing -= 1
            if not _writing:
                spark.conf.set(CLEANUP, _before)


LARGE_ROWS = 8  # rows of megabytes each that a parquet reader or writer holds at a time


def materialise(frame: DataFrame, label: str, replaces: DataFrame | None = None, large: bool = False) -> DataFrame:
    """Write ``frame`` as a parquet table and return the table.

    Compared with a cached frame the table survives executor loss, is read with
    column pruning and filter pushdown, and has a known size for join planning.
    ``replaces`` is an earlier table of an iteration, deleted once the new one
    is complete. Of ``large`` rows, of megabytes each, a row group has LARGE_ROWS,
    which bounds what a task holds to write and to read them. The shuffle files
    of the write are deleted with its end.
    """
    spark = frame.sparkSession
    path = scratch_path(spark, label)
    with shuffles_dropped(spark):
        frame.write.options(**{"parquet.block.row.count.limit": LARGE_ROWS} if large else {}).parquet(path)
    table = spark.read.schema(frame.schema).parquet(path)
    _tables[table] = path
    _stored.setdefault(spark.sparkContext.applicationId, set()).add(path)
    if replaces is not None and replaces in _tables:
        _delete(spark, _tables.pop(replaces))
    return table


def discard(frame: DataFrame) -> None:
    """Delete a table that :func:`materialise` returned and nothing will read again."""
    if frame in _tables:
        _delete(frame.sparkSession, _tables.pop(frame))


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _stored[spark.sparkContext.applicationId].discard(name)


def folder_bytes(spark: SparkSession, folder: str) -> int:
    """Stored size of everything in a folder, 0 when it is not there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.getContentSummary(path).getLength() if files.exists(path) else 0


def drop_stored(spark: SparkSession) -> int:
    """Delete the tables this application stored; frames built on them become unreadable."""
    names = sorted(_stored.get(spark.sparkContext.applicationId, ()))
    for name in names:
        _delete(spark, name)
    return len(names)
