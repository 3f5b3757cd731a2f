import numpy as np
import pytest

from scriptorium.llm import prefix_forest
from scriptorium.llm.prefix_forest import Forest, nearest

SCHEMA = "vec_id long, embedding array<float>, score string"


def exact(rows, queries, k):
    usable = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)}
    return {q: sorted(((-float(np.dot(usable[q], x)), i) for i, x in usable.items() if i != q and len(x) == len(usable[q])))[:k] for q in queries if q in usable}


def test_recall_and_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(prefix_forest, "SHARD_ROWS", 700)
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(24) * rng.uniform(0.3, 2)).astype(np.float32).tolist(), "x") for i in range(2000)]
    v = spark.createDataFrame(rows, SCHEMA)
    got = nearest(v, v.filter("vec_id % 20 = 0"), k=20).collect()
    want = exact(rows, [i for i, *_ in rows if i % 20 == 0], 20)
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    hits = 0
    for q, best in want.items():
        mine = sorted(by[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert [(-r["score"], r["vec_id"]) for r in mine] == sorted((-r["score"], r["vec_id"]) for r in mine)
        hits += len({r["vec_id"] for r in mine} & {i for _, i in best})
    assert hits / (20 * len(want)) >= 0.9


def test_odd_vectors_copies_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], "q"), (20, [1.0, 1.0], "q"), (40, None, "q"), (60, [0.0, 0.0], "q"), (80, [1.0, nan], "q"), (None, [1.0, 2.0], "n"), (1, [inf, 0.0], "i"), (2, [None, 1.0], "n"), (7, [1.0, 0.0, 0.0], "w")]
    rows += [(100 + i, [2.0, 0.0], "copy") for i in range(61) if (100 + i) % 20] + [(5, [0.5, -0.0], "t"), (6, [0.5, 0.0], "t"), (6, [0.5, 0.0], "t")]
    v = spark.createDataFrame(rows, SCHEMA)
    got = nearest(v, v.filter("vec_id % 20 = 0"), k=20).collect()
    want = exact(list(dict.fromkeys((a, None if b is None else tuple(b), c) for a, b, c in rows)), [0, 20], 20)
    for q, best in want.items():
        mine = sorted(((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q))
        assert [(i, pytest.approx(s)) for _, i, s in mine] == [(i, -s) for s, i in best]
    assert {r["query_id"] for r in got} == {0, 20}
    few = spark.createDataFrame([(0, [1.0, 0.0], ""), (3, [1.0, 0.5], "")], SCHEMA)
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in nearest(few, few.filter("vec_id % 20 = 0")).collect()] == [(0, 1, 3)]
    assert nearest(few.limit(0), few.limit(0)).count() == 0


def test_candidates_share_the_longest_prefixes():
    rng = np.random.default_rng(1)
    points = rng.standard_normal((500, 16))
    forest = Forest(points, float(np.linalg.norm(points, axis=1).max()))
    for found in forest.search(points[:20], 30):
        assert len(found) >= 30 and len(found) == len(set(found.tolist()))
