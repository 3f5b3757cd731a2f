"""k-means with all runs in one pass, against the same algorithm in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.operators import clustering as C


def plain(x, centres, variance):
    for _ in range(C.MOST_PASSES + 1):
        d = ((x[:, None] - centres[None]) ** 2).sum(-1)
        at = d.argmin(1)
        cost = d.min(1).sum()
        new = np.stack([x[at == j].mean(0) if (at == j).any() else centres[j] for j in range(len(centres))])
        if ((new - centres) ** 2).sum() <= C.TOLERANCE * variance:
            return centres, cost
        centres = new
    return centres, cost


def test_all_runs_in_one_pass(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.4, (40, 3)) for c in ((0, 0, 0), (3, 0, 1), (0, 4, 2))])
    df = spark.createDataFrame([(f"{i:03d}", v.tolist()) for i, v in enumerate(x)] + [("none", None)], "jd_id string, features array<double>").repartition(5)
    points = df.where("features is not null").select(F.col("jd_id").alias("id"), F.col("features").alias("x"))
    runs = [(k, r) for k in (2, 3, 5) for r in range(3)]
    starts = C._first_centres(points, runs, 42)
    variance = x.var(0).mean()
    got = C.lloyd(points, runs)
    best = {}
    for run in runs:
        centres, cost = plain(x, starts[run], variance)
        assert got[run][1] == pytest.approx(cost)
        assert np.allclose(got[run][0], centres)
        best[run[0]] = min(best.get(run[0], np.inf), cost)
    assignments, centres, costs = C.kmeans_many(df, [2, 3, 5], restarts=3)
    assert costs == pytest.approx(best)
    rows = assignments.where("k = 3").collect()
    assert len(rows) == 120 and len({r["cluster"] for r in rows}) == 3
    assert all(len({r["cluster"] for r in rows if int(r["jd_id"]) // 40 == b}) == 1 for b in range(3))
    assert centres.where("k = 5").count() == 5


def test_repeated_few_and_no_points(spark):
    schema = "jd_id string, features array<float>"
    same = spark.createDataFrame([(str(i), [1.0, 2.0]) for i in range(4)], schema)
    a, _, cost = C.kmeans(same, k=9)
    assert a.count() == 4 and cost == pytest.approx(0.0)
    a, centres, cost = C.kmeans(same.limit(0), k=2)
    assert a.count() == 0 and centres.count() == 0


def test_optimal_k(spark):
    rng = np.random.default_rng(7)
    rows = [(f"{b}{i:02d}", rng.normal((9 * b, -5 * b), 0.3).tolist()) for b in range(3) for i in range(12)]
    out = {r["k"]: r for r in C.find_optimal_k(spark.createDataFrame(rows, "jd_id string, features array<double>"), [2, 3, 6, 99], restarts=4).collect()}
    assert set(out) == {2, 3, 6} and [k for k in out if out[k]["best"]] == [3]
    assert out[3]["cost"] < out[2]["cost"] and out[3]["silhouette"] > 0.8


def test_vectors_by_entries_give_the_clusters_of_whole_ones(spark, monkeypatch):
    rng = np.random.default_rng(8)
    words = [[f"{g}{i}" for i in range(12)] for g in "abc"]
    docs = spark.createDataFrame([(str(i), "" if i == 7 else " ".join(rng.choice(words[i % 3], 15))) for i in range(60)], "jd_id string, jd_text string")
    kept, tables = C.written, []
    monkeypatch.setattr(C, "written", lambda df, name: tables.append(kept(df, name)) or tables[-1])
    found = []
    for sparse in (False, True):
        a, centres, cost = C.kmeans(C.embed_text(docs, sparse=sparse), k=4, restarts=2, most=10)
        found.append(({r["jd_id"]: r["cluster"] for r in a.collect()}, [r["center"] for r in centres.orderBy("cluster").collect()], cost))
    assert found[0][0] == found[1][0] and np.allclose(found[0][1], found[1][1]) and abs(found[0][2] - found[1][2]) < 1e-6
    # A vector by its entries holds its words, not all 4,096 numbers.
    assert max(len(r["x"]) for r in tables[1].collect()) <= 12 < max(len(r["x"]) for r in tables[0].collect())


def test_a_pass_brings_one_row_for_each_run(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    points = spark.createDataFrame([(str(i), [float(i % 7), float(i % 3)]) for i in range(60)], "id string, x array<double>").repartition(4)
    kept, sizes = DataFrame.toArrow, []
    monkeypatch.setattr(DataFrame, "toArrow", lambda df: sizes.append(df.columns + [(t := kept(df)).num_rows]) or t)
    C.lloyd(points, [(3, 0), (5, 0), (5, 1)], most=0)
    assert [s[-1] for s in sizes if s[0] == "run"] == [4]
