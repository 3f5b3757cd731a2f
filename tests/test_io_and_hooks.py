"""File sources and sinks, plan-time helpers, hooks (S01, S04, S05, S10-S12, K01-K03, K06,
P04-P06, P10, R05, X01-X03, C11)."""

import json
import os
import tempfile

import pandas as pd
from pyspark.sql import functions as F

from scriptorium.operators import cleaning, discovery, quality, requirements
from scriptorium.sources import records as R


def _tmpdir():
    return tempfile.mkdtemp(prefix="scriptorium-test-")


def test_whole_file_json_sources(spark):
    d = _tmpdir()
    with open(os.path.join(d, "a.json"), "w") as f:
        json.dump({"content": [{"job_id": "1"}, {"job_id": "2"}, 7]}, f)
    with open(os.path.join(d, "b.json"), "w") as f:
        json.dump([{"job_id": "3"}], f)
    with open(os.path.join(d, "c.json"), "w") as f:
        f.write("{broken")
    with open(os.path.join(d, "notes.txt"), "w") as f:
        f.write("ignored")
    files = R.read_json_files(spark, d)
    recs = R.explode_records(files)
    got = sorted((r["id"], os.path.basename(r["_source_file"])) for r in recs.select(F.try_variant_get("record", "$.job_id", "string").alias("id"), "_source_file").collect())
    assert got == [("1", "a.json"), ("2", "a.json"), ("3", "b.json")]  # S01, S02, S04
    assert R.malformed(files).count() == 1  # S03
    st = R.file_stats(spark, d).first()  # S05
    assert st["num_files"] == 3 and st["files"] == ["a.json", "b.json", "c.json"] and not st["files_truncated"]


def test_csv_evaluations_round_trip(spark):
    d = _tmpdir()
    path = os.path.join(d, "evals.csv")
    pd.DataFrame(
        {"jd_id": ["1", "1", "2"], "eval_completeness": [3, 4, None], "eval_overall_score": [None, 5, None], "eval_is_gold_standard": ["TRUE", "yes", ""]}
    ).to_csv(path, index=False)
    raw = R.read_evaluations(spark, path)  # S10, S14
    ev = {r["jd_id"]: r for r in quality.import_csv_evaluations(raw, order_col="_file_order").collect()}
    assert list(ev) == ["1"] and ev["1"]["completeness"] == 4 and ev["1"]["is_gold_standard"] is False


def test_sinks_and_checkpointed_append(spark):
    d = _tmpdir()
    df = spark.createDataFrame([("1", [1.0, 2.0]), ("2", [3.0, 4.0])], "jd_id string, features array<double>")
    R.write_table(df, os.path.join(d, "vec"))  # K03
    assert spark.read.parquet(os.path.join(d, "vec")).where("jd_id = '2'").first()["features"] == [3.0, 4.0]
    R.write_table(df.select("jd_id"), os.path.join(d, "csv"), fmt="csv")  # K01
    assert spark.read.option("header", True).csv(os.path.join(d, "csv")).count() == 2
    R.write_table(df.select("jd_id"), os.path.join(d, "json"), fmt="json")  # K02, S11
    assert spark.read.json(os.path.join(d, "json")).count() == 2
    out = os.path.join(d, "runs")  # K06: append per run partition, nothing rewritten
    for run in ("r1", "r2"):
        R.write_table(df.withColumn("run", F.lit(run)), out, mode="append", partition_by="run")
    assert spark.read.parquet(out).groupBy("run").count().count() == 2


def test_plan_time_helpers(spark):
    cols = ["jd_id", "Team Description", "expertise_text", "_raw", "org_unit"]
    assert discovery.available_columns(spark.createDataFrame([], "a string, b string"), ["b", "c"]) == ["b"]  # P04
    msgs = discovery.validate_config(cols, "jd_text", "jd_id", {"level": "no stratification by level"})  # P05
    assert ("error", "jd_text", "required field 'jd_text' not found") in msgs and msgs[-1][0] == "warning"
    assert discovery.detect_column(cols, "expertise") == "expertise_text"  # P06
    assert discovery.detect_column(cols, "team", "desc") == "Team Description"
    df = spark.createDataFrame([("1", "x")], "jd_id string, _raw string")
    assert discovery.public_columns(df).columns == ["jd_id"]  # P10


def test_completeness_gate_and_resume(spark):
    todo = spark.createDataFrame([("1", "{}"), ("2", "{bad"), ("3", "{}")], "jd_id string, response string")
    done = requirements.parse_response(todo.where("jd_id = '2'"))
    assert not requirements.completeness_gate(done, todo)  # R05
    res = requirements.extract_batch(todo, requirements.parse_response, done)
    assert res.count() == 3 and res.where("jd_id = '2'").count() == 1
    retried = requirements.extract_batch(todo, requirements.parse_response, done, retry_failed=True)
    assert retried.count() == 3


def test_custom_cleaner_and_hooks(spark):
    df = spark.createDataFrame([("1", "x" * 60, " Sales ")], "jd_id string, jd_text string, org_unit string")
    out = cleaning.clean_corpus(df, custom_cleaners={"org_unit": lambda c: F.upper(F.trim(c))})  # X01
    assert out.first()["org_unit"] == "SALES"

    def embed_fn(batches):  # X02: any embedder as an Arrow batch function
        for pdf in batches:
            yield pd.DataFrame({"jd_id": pdf["jd_id"], "features": [[float(len(t)), 1.0] for t in pdf["jd_text"]]})

    vec = df.mapInPandas(embed_fn, "jd_id string, features array<double>")
    assert vec.first()["features"] == [60.0, 1.0]

    def parser(d):  # X03: a parser is any DataFrame -> DataFrame function
        return d.select("jd_id", F.length("jd_text").alias("n"))

    assert df.transform(parser).first()["n"] == 60
    assert df.select(F.current_timestamp().alias("t")).first()["t"] is not None  # C11


def test_stream_equals_batch(spark):
    d = _tmpdir()
    src = os.path.join(d, "in")
    for i in range(3):
        # files arrive in event-time order; rows older than the watermark would be dropped as late
        spark.createDataFrame([(i * 10 + j, "2024-01-%02d 00:00:00" % (i * 5 + j + 1), float(j)) for j in range(5)], "id long, ts string, v double").withColumn(
            "ts", F.to_timestamp("ts")
        ).coalesce(1).write.mode("append").parquet(src)
    from scriptorium.streaming import incremental as X

    schema = spark.read.parquet(src).schema
    s = X.stream_source(spark, src, schema, max_files_per_trigger=1)  # X-ST1, S12
    out = X.run_available_now(X.unseen_records(s, "id", "ts"), X.new_run_name("test"))
    assert spark.read.parquet(out).count() == spark.read.parquet(src).count() == 15
