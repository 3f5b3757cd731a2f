"""Helpers shared by the operators: written intermediate tables and gapless numbering."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.session import ensure_checkpoint_dir

# Spark's setting that removes a query's shuffle files when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
WORD = r"[^\x20\x09-\x0D]+"
# Up to this many ids a list is broadcast (16 MB), beyond it is joined by shuffle.
BROADCAST_IDS = 1_000_000


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the driver and all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The table cuts lineage: a lost executor costs the tasks that read it, not
    the work behind it, and several later jobs can scan it.  The shuffle files
    behind it are not needed any more and go when it is written.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``staged`` returned and that nothing reads any more: all that was made of them is written."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._staged_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def without(rows: DataFrame, gone: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` whose ``key`` (a number) is not in ``gone`` (key); a short list is broadcast, so that the rows stay where they are."""
    gone = staged(gone, name)
    return rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, key, "left_anti")


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str, buckets: int = 256) -> DataFrame:
    """Add ``name``: 0, 1, 2 ... without gaps within each value of ``keys``.

    ``order`` must tell rows apart up to exact repeats.  A key may hold any
    share of the rows: rows are ranked inside ``buckets`` hash slices of each
    key, and the slices' sizes give every slice its first number.
    """
    spread = df.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sizes = spread.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select(*keys, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    ranked = spread.withColumn("_rank", F.row_number().over(inside) - 1)
    out = ranked.join(first, [*keys, "_slice"])
    return out.withColumn(name, F.col("_first") + F.col("_rank")).drop("_slice", "_rank", "_first")
