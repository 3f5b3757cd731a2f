import json

import pytest

from scriptorium.sources import records as R
from scriptorium.sources.paged import JsonPages


@pytest.fixture
def pages(tmp_path):
    for page in range(3):
        rows = [{"id": 10 * page + i, "name": f"n{i}", "extra": [1]} for i in range(4)] + [{"id": None}, {"name": "no id"}]
        (tmp_path / f"page-{page}.json").write_text("\n".join(json.dumps(r) for r in rows) + "\n\n")
    (tmp_path / "notes.txt").write_text("not a page")
    return f"file://{tmp_path}"


def read(spark, path):
    spark.dataSource.register(JsonPages)
    return R.read_source(spark, "json_pages", path, schema="id long, name string")


def test_pages_are_partitions(spark, pages):
    df = read(spark, pages)
    assert df.rdd.getNumPartitions() == 3
    assert df.count() == 18 and df.where("id is null").count() == 6
    assert sorted(r["id"] for r in df.where("name = 'n2'").collect()) == [2, 12, 22]


def test_filters_reach_the_pages(spark, pages):
    kept = read(spark, pages).where("id >= 12 and name in ('n1', 'n2', 'n3') and length(name) = 2")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    # What the pages judge is no longer Spark's work.
    conditions = [line for line in plan.splitlines() if "Filter" in line and "length" in line]
    assert conditions and ">=" not in conditions[0] and " IN " not in conditions[0]
    assert sorted(r["id"] for r in kept.collect()) == [12, 13, 21, 22, 23]


def test_no_pages(spark, tmp_path):
    with pytest.raises(Exception, match="no pages"):
        read(spark, f"file://{tmp_path}").count()


def test_record_chunks(spark):
    df = spark.range(2345).selectExpr("cast(id as string) as jd_id", "id % 7 as other").repartition(6)
    rows = R.record_chunks(df, ["jd_id"], 1000).orderBy("jd_id").collect()
    assert [r["chunk"] for r in rows] == [0] * 1000 + [1] * 1000 + [2] * 345
    assert R.record_chunks(df.limit(0), ["jd_id"]).count() == 0


def test_files_sorted_and_missing(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        R.read_json_files(spark, str(tmp_path))
    for name in ("b", "a", "c"):
        (tmp_path / f"{name}.json").write_text("{}")
    assert [r["_source_file"][-6:] for r in R.read_json_files(spark, str(tmp_path)).collect()] == ["a.json", "b.json", "c.json"]
    st = R.file_stats(spark, str(tmp_path)).first()
    assert st["files"] == ["a.json", "b.json", "c.json"] and st["num_files"] == 3
