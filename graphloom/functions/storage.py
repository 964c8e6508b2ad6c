"""Tables written to the folder that driver and executors share, to cut lineage or to read a result several times.

A result is read when it is used, so its tables can't go while a query returns it. They go when the driver ends, or before by ``release``; what only led to a stored table (its
shuffle files, and tables named to ``drop``) goes at once, so the disk that a long iteration takes is that of one step and of what it keeps.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid
import weakref
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no checkpoint folder and runs on this machine alone, as in local tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"

#: Spark then removes an execution's shuffle files when it has ended, not when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_written: list[str] = []
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (found or LOCAL_CHECKPOINTS).rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which goes with the driver."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read again; it survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with _own_shuffles_removed(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


@contextlib.contextmanager
def _own_shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Executions in it remove their shuffle files; a choice of the user's own stays."""
    if spark.conf.get(CLEANUP, None) is not None:
        yield
        return
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP)


def drop(*tables: DataFrame) -> None:
    """Removes tables that ``stored`` returned and that nothing still to be computed reads; others are left alone."""
    for df in tables:
        if (name := _paths.pop(df, None)) in _written:
            _written.remove(name)
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> int:
    """Removes all tables that this driver has written so far, and says how many: call it when no result that was made of them is read any more."""
    n = 0
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return n


@atexit.register
def _at_exit() -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        if _written and (spark := SparkSession.getActiveSession()) is not None:
            release(spark)
