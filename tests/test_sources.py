"""Raw JSON records, paths, flattening and discovery on literals."""

from pyspark.sql import functions as F

from scriptorium.operators import discovery as D
from scriptorium.sources import records as R


def test_record_shapes_and_broken(spark):
    df = spark.createDataFrame(
        [('{"content":[{"a":1},3,{"a":2}]}',), ('[{"a":3}]',), ('{"a":4}',), ("{broken",)], "value string"
    )
    recs = R.explode_records(df).select(F.try_variant_get("record", "$.a", "int").alias("a")).collect()
    assert sorted(r["a"] for r in recs) == [1, 2, 3, 4]
    assert R.malformed(df).count() == 1


def test_path_get(spark):
    df = spark.createDataFrame([('{"a":{"b":1,"c":[5,6]},"d":{"0":"k"}}',)], "value string")
    r = R.explode_records(df)
    row = r.select(
        D.path_get(F.col("record"), "a.b").alias("ab"), D.path_get(F.col("record"), "a.c.1").alias("c1"),
        D.path_get(F.col("record"), "a.c.9").alias("c9"), D.path_get(F.col("record"), "d.0").alias("d0"),
        D.path_get(F.col("record"), "x.y").alias("xy"),
    ).first()
    assert (row["ab"], row["c1"], row["c9"], row["d0"], row["xy"]) == ("1", "6", None, "k", None)


def test_path_get_walks_any_number_of_digit_parts(spark):
    df = spark.createDataFrame([('{"a":[[[[["x",{"0":"y"}]]]]]}',)], "value string")
    r = R.explode_records(df)
    row = r.select(D.path_get(F.col("record"), "a.0.0.0.0.0").alias("x"), D.path_get(F.col("record"), "a.0.0.0.0.1.0").alias("y")).first()
    assert (row["x"], row["y"]) == ("x", "y")


def test_schema_summary_reaches_every_level_and_element(spark):
    texts = [
        ('{"a":{"b":{"c":{"d":{"e":{"f":{"g":{"h":"} {"}}}}}}},"l":[1,{"x":1},{"x":2},{"x":3},{"y":{"z":"{"}}]}',),
        ('{"a":{"k":1}}',),
    ]
    s = {r["path"]: r for r in D.schema_summary(R.explode_records(spark.createDataFrame(texts, "value string"))).collect()}
    assert s["a.b.c.d.e.f.g.h"]["types"] == "string" and s["a.b.c.d.e.f.g"]["nested_keys"] == "h"
    assert s["l[*].x"]["count"] == 3 and s["l[*].y.z"]["types"] == "string"
    assert s["a"]["nested_keys"] == "b,k" and s["a"]["count"] == 2 and s["l"]["nested_keys"] == ""
    assert D.schema_summary(R.explode_records(spark.createDataFrame(texts[:0], "value string"))).count() == 0


def test_schema_summary_types(spark):
    df = spark.createDataFrame([('{"a":{"b":1,"c":[1,2]},"s":"hi","n":null,"t":true,"f":1.5}',)], "value string")
    s = {r["path"]: r for r in D.schema_summary(R.explode_records(df)).collect()}
    assert s["a"]["types"] == "object" and s["a"]["nested_keys"] == "b,c"
    assert s["a.b"]["types"] == "integer" and s["a.c"]["types"] == "array" and s["a.c"]["arr_max_len"] == 2
    assert s["t"]["types"] == "boolean" and s["f"]["types"] == "number" and s["n"]["types"] == "null"


def test_flatten(spark):
    df = spark.createDataFrame([({"b": 1, "c": [1, 2]},)], "a struct<b:int,c:array<int>>")
    assert D.flatten(df).columns == ["a.b", "a.c"]


def test_eval_format_dispatch():
    import pytest

    assert R.evaluation_format("x.csv") == "csv"
    with pytest.raises(ValueError):
        R.evaluation_format("x.xlsx")
