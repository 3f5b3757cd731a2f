"""Streams over several files with rows out of order and ids that come again (X-ST2, X-ST3)."""

from pyspark.sql import functions as F

from scriptorium.session import scratch_path
from scriptorium.streaming import incremental as X

# One file each, as of the review: ids 1 and 2 apart by months, id 4 before all, id 1 again late, one null id twice.
ROWS = [(1, "2024-03-01", 1.0), (2, "2024-06-01", 2.0), (3, "2024-06-02", 4.0), (4, "2024-01-01", 8.0), (1, "2024-09-01", 16.0), (5, "2024-01-02", None), (None, "2024-02-01", 3.0), (None, "2024-07-01", 5.0)]


def stream(spark):
    src = scratch_path(spark, X.new_run_name("late"))
    for i, row in enumerate(ROWS):
        one = spark.createDataFrame([row], "id long, day string, v double").select("id", F.to_timestamp("day").alias("ts"), "v")
        one.coalesce(1).write.parquet(f"{src}/{i}")
    return X.stream_source(spark, f"{src}/*", spark.read.parquet(f"{src}/0").schema, max_files_per_trigger=1)


def test_every_id_once_however_late(spark):
    out = X.run_available_now(stream(spark), X.new_run_name("unseen"), foreach_batch=X.append_unseen("id"))
    got = spark.read.parquet(out)
    assert sorted(str(r["id"]) for r in got.collect()) == ["1", "2", "3", "4", "5", "None"]
    assert got.select("_batch").distinct().count() > 1
    # A batch that is run again replaces its own part.
    batch = got.filter("_batch = 1").drop("_batch").localCheckpoint()
    X.append_unseen("id")(batch, 1, out)
    assert spark.read.parquet(out).count() == 6
    state = X.run_available_now(X.unseen_records(stream(spark), "id", "ts"), X.new_run_name("state"))
    assert sorted(str(r["id"]) for r in spark.read.parquet(state).collect()) == ["1", "2", "3", "4", "5", "None"]


def test_late_rows_count_in_their_period(spark):
    out = X.run_available_now(stream(spark), X.new_run_name("periods"), foreach_batch=X.sum_periods("ts", "v", "30 days"))
    got = {r["window_start"]: (r["mean"], r["count"]) for r in X.period_means(spark, out).collect()}
    data = spark.createDataFrame(ROWS, "id long, day string, v double").withColumn("ts", F.to_timestamp("day"))
    want = data.groupBy(F.window("ts", "30 days").alias("w")).agg(F.avg("v").alias("mean"), F.count("*").alias("n")).collect()
    assert got == {r["w"]["start"]: (r["mean"], r["n"]) for r in want} and sum(n for _, n in got.values()) == len(ROWS)
