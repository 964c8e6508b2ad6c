"""What the operators of this subpackage have in common: shared storage, partition counts, ids of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.storage import scratch, stored  # noqa: F401  their tables go with the driver

#: Tables of at most so many narrow rows are sent to all executors.
BROADCAST_ROWS = 300_000
#: Parts into which a key's rows are dealt where its table is too large to be sent to all executors.
SALTS = 16


def discard(spark: SparkSession, *paths: str) -> None:
    """Removes scratch tables that no later step reads."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, to be broadcast if it has at most ``rows`` rows (of a fixed width); otherwise Spark's joins deal it out.

    ``df`` should be stored, as it is counted.
    """
    return F.broadcast(df) if df.count() <= rows else df


def meet(rows: DataFrame, keys: DataFrame, key: str | list[str], *, spread: str | list[str], broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` joined to ``keys`` (stored; one row for each key, of a fixed width), whatever share of the rows one key has.

    Few keys are broadcast; otherwise each key's rows are dealt to ``SALTS`` tasks by a hash of the columns ``spread``.
    """
    names = [key] if isinstance(key, str) else key
    if keys.count() <= broadcast_rows:
        return rows.join(F.broadcast(keys), names)
    by = [spread] if isinstance(spread, str) else spread
    salted = keys.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(F.lit("salt"), *by), F.lit(SALTS)).cast("int")).join(salted, [*names, "__salt"]).drop("__salt")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
