"""Stream queries: run to completion with ``availableNow`` and read back (F12 events)."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions.numeric import rnd

from scriptorium.sources.tables import table
from scriptorium.streaming import incremental as X
from scriptorium.plans.registry import query


def _events_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    # the events table is one file: the stream reads it through a glob on its
    # name; event time must be TIMESTAMP for windows (session zone UTC)
    s = X.stream_source(spark, f"{sf.rstrip('/')}/events*.parquet", schema, max_files_per_trigger=1)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


@query("xst1_incremental_load", "SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def q_x1(spark, sf):
    out = X.run_available_now(_events_stream(spark, sf), X.new_run_name("load"))
    return spark.read.parquet(out).groupBy("event_type").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@query(
    "xst2_incremental_extract",
    "SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(sum(CAST(json_extract(props, '$.k') AS DOUBLE)), 3) AS k_sum FROM events GROUP BY 1",
)
def q_x2(spark, sf):
    s = _events_stream(spark, sf).select("event_id", "event_type", F.get_json_object("props", "$.k").cast("double").alias("k"))
    out = X.run_available_now(s, X.new_run_name("extract"), foreach_batch=X.append_unseen("event_id"))
    return spark.read.parquet(out).groupBy("event_type").agg(F.count(F.lit(1)).cast("bigint").alias("n"), rnd(F.sum("k"), 3).alias("k_sum"))


@query(
    "xst3_period_quality",
    """SELECT strftime(make_timestamp(CAST(floor(epoch(ts) / 2592000) * 2592000 * 1000000 AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS window_start,
  event_type, round(avg(value), 6) AS mean, CAST(count(*) AS BIGINT) AS count FROM events GROUP BY 1, 2""",
)
def q_x3(spark, sf):
    out = X.run_available_now(_events_stream(spark, sf), X.new_run_name("period"), foreach_batch=X.sum_periods("ts", "value", "30 days", ["event_type"]))
    means = X.period_means(spark, out, ["event_type"])
    start = F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start")
    return means.select(start, "event_type", rnd("mean", 6).alias("mean"), "count")
