import numpy as np

from pyspark.sql import functions as F

from scriptorium.operators import clustering as C
from scriptorium.plans import q_reports


def test_scores_of_all_k_without_a_join_equal_the_evaluator(spark):
    vec = np.random.default_rng(2).normal(size=(40, 3))
    rows = [(f"{i:02d}", v.tolist()) for i, v in enumerate(vec)] + [("far", [90.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "jd_id string, features array<double>")
    assigned, centres, _ = C.kmeans_many(df, [3, 5], restarts=2, most=5)
    got = C.silhouettes_sq(df.unionByName(spark.createDataFrame([(None, [1.0, 1.0, 1.0])], df.schema)), centres)
    assert set(got) == {3, 5}
    for k, score in got.items():
        assert abs(score - C.silhouette_sq(df, assigned.where(F.col("k") == k).drop("k"))) < 1e-9


def test_experiments_join_vectors_only_where_ids_repeat(spark, monkeypatch):
    items = spark.createDataFrame([(str(i), 1, "technical", "required", f"skill{i % 7} bolt{i % 3}") for i in range(24)], "jd_id string, pos int, category string, kind string, item string")
    joins, kept = [], C.silhouette_sq
    monkeypatch.setattr(q_reports.C, "silhouette_sq", lambda *a: joins.append(1) or kept(*a))
    monkeypatch.setattr(q_reports, "PRESETS", {"skills_only": {"approach": "skills_only"}})
    for again, expected in ((0, 0), (1, 2)):
        meta = spark.createDataFrame([(str(i % 24), f"d{i % 2}", "x") for i in range(24 + again)], "jd_id string, division string, function string")
        monkeypatch.setattr(q_reports, "fx", lambda spark, sf, name: items if name == "f_items" else meta)  # noqa: B023
        joins.clear()
        assert q_reports.q_m17(spark, "").count() == 2
        assert len(joins) == expected
