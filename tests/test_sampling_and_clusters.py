"""Invariants of sampling, archetypes and clustering."""

from pyspark.sql import functions as F

from scriptorium.operators import archetypes as A
from scriptorium.operators import clustering as C
from scriptorium.operators import sampling


def test_stratified_sample_size_and_minimum(spark):
    rows = [(str(i), f"org{i % 7}", f"l{i % 3}") for i in range(300)] + [("n1", None, "l0")]
    df = spark.createDataFrame(rows, "jd_id string, org_unit string, level string")
    s = sampling.sample_stratified(df, n=50, min_per_stratum=1).collect()
    assert len(s) == 50 and len({r["jd_id"] for r in s}) == 50
    strata = {(r["org_unit"], r["level"]) for r in s if r["sample_pass"] == 1}
    assert len(strata) == 21  # every stratum got its minimum


def test_more_strata_than_n(spark):
    rows = [(str(i), f"o{i}", "l") for i in range(20)]
    df = spark.createDataFrame(rows, "jd_id string, org_unit string, level string")
    s = sampling.sample_stratified(df, n=5).collect()
    assert sorted(r["org_unit"] for r in s) == ["o0", "o1", "o10", "o11", "o12"]  # key order


def test_item_frequency_counts_repeats(spark):
    assign = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "jd_id string, cluster int")
    items = spark.createDataFrame(
        [("a", 1, "technical", "required", "sql"), ("a", 2, "technical", "required", "sql"), ("b", 1, "technical", "required", "sql")],
        "jd_id string, pos int, category string, kind string, item string",
    )
    f = A.item_frequency(assign, items).first()
    assert f["count"] == 3 and abs(f["freq"] - 1.5) < 1e-9  # two members with extraction


def test_kmeans_two_blobs(spark):
    rows = [(f"a{i}", [0.0 + i * 0.01, 0.0]) for i in range(20)] + [(f"b{i}", [10.0 + i * 0.01, 10.0]) for i in range(20)]
    df = spark.createDataFrame(rows, "jd_id string, features array<float>")
    a, centres, _ = C.kmeans(df, k=2, restarts=2)
    groups = a.groupBy("cluster").agg(F.collect_set(F.substring("jd_id", 1, 1)).alias("g")).collect()
    assert sorted(len(g["g"]) for g in groups) == [1, 1]
    assert centres.count() == 2
    assert -1.0 <= C.silhouette_sq(df, a) <= 1.0


def test_unit_norms(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    out = [r[0] for r in df.select(C.l2_normalize(F.col("v"))).collect()]
    assert out[0] == [0.6, 0.8] and out[1] == [0.0, 0.0]
