"""Structured Streaming forms of the incremental steps (X-ST1, X-ST2, X-ST3, K06).

* X-ST1: bounded chunks of new records = a file stream with
  ``maxFilesPerTrigger`` run with ``availableNow``.
* X-ST2: process only unseen ids and save as you go = each micro-batch,
  deduplicated in itself, less the ids of the result table (restarts resume from
  the checkpoint; a repeated batch replaces its own part).
* X-ST3: quality per period as data arrives = each micro-batch's sums by
  event-time tumbling window are stored; readers add them up.

Neither uses a watermark: rows may come in any order, at any time.

Checkpoints and output tables go under the cluster's shared
``spark.checkpoint.dir`` (set by the session; only tests set their own).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from scriptorium.session import scratch_path


def stream_source(spark: SparkSession, path: str, schema, fmt: str = "parquet", max_files_per_trigger: int | None = None) -> DataFrame:
    """X-ST1: a file stream; each trigger takes at most ``max_files_per_trigger`` new files."""
    r = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def run_available_now(stream: DataFrame, name: str, mode: str = "append", fmt: str = "parquet", foreach_batch=None) -> str:
    """Run a stream over all data present now (then stop); returns the output path.

    The output and checkpoint live under the shared checkpoint folder; a
    restarted run with the same name continues from its checkpoint.
    """
    spark = stream.sparkSession
    base = scratch_path(spark, f"streams/{name}")
    out, ckpt = f"{base}/out", f"{base}/checkpoint"
    w = stream.writeStream.option("checkpointLocation", ckpt).outputMode(mode).trigger(availableNow=True)
    if foreach_batch is not None:
        q = w.foreachBatch(lambda b, i: foreach_batch(b, i, out)).start()
    else:
        q = w.format(fmt).option("path", out).start()
    q.awaitTermination()
    return out


def unseen_records(stream: DataFrame, id_field: str, ts_col: str | None = None) -> DataFrame:
    """X-ST2 with the ids in the stream's state, which holds all of them: every id once, however late.

    ``ts_col`` is not needed.  For many ids use ``append_unseen``.
    """
    return stream.dropDuplicates([id_field])


def _write_batch(rows: DataFrame, batch_id: int, out: str) -> None:
    """A batch's own part of the result table; a repeated batch replaces it."""
    rows.write.mode("overwrite").parquet(f"{out}/_batch={batch_id}")


def append_unseen(id_field: str):
    """X-ST2 as a foreachBatch sink: adds the rows whose id the result table lacks (null is one id)."""

    def add(batch: DataFrame, batch_id: int, out: str) -> None:
        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(out)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).mkdirs(path)
        schema = StructType([*batch.schema.fields, StructField("_batch", LongType())])
        seen = spark.read.schema(schema).parquet(out).where(F.col("_batch") != batch_id).select(F.col(id_field).alias("_seen"))
        new = batch.dropDuplicates([id_field]).join(seen, F.col(id_field).eqNullSafe(F.col("_seen")), "left_anti")
        _write_batch(new, batch_id, out)

    return add


def sum_periods(ts_col: str, value_col: str, period: str = "30 days", keys=()):
    """X-ST3 as a foreachBatch sink: each batch's sums per event-time period (tumbling window) and key."""

    def add(batch: DataFrame, batch_id: int, out: str) -> None:
        sums = batch.groupBy(F.window(ts_col, period).alias("w"), *keys).agg(
            F.sum(value_col).alias("total"), F.count(value_col).alias("valued"), F.count(F.lit(1)).alias("count")
        )
        _write_batch(sums.select(F.col("w.start").alias("window_start"), *keys, "total", "valued", "count"), batch_id, out)

    return add


def period_means(spark: SparkSession, out: str, keys=()) -> DataFrame:
    """Mean and count per period and key from the sums of all batches."""
    return spark.read.parquet(out).groupBy("window_start", *keys).agg(
        (F.sum("total") / F.nullif(F.sum("valued"), F.lit(0))).alias("mean"), F.sum("count").cast("bigint").alias("count")
    )


def new_run_name(prefix: str) -> str:
    return f"{prefix}-{uuid.uuid4().hex[:8]}"
