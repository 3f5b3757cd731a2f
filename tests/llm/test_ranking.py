import random

import numpy as np
from pyspark.sql import functions as F

from scriptorium.llm.ranking import features, fit, score_quality


def corpus(n):
    rng = random.Random(7)
    docs, labels = [], []
    for i in range(n):
        words = ["w" + "abcdefgh"[rng.randint(0, 7)] * rng.randint(1, 6) for _ in range(rng.randint(20, 120))]
        good = i % 4 != 0
        docs.append((i, " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words), "en", 0.5))
        labels.append((i, int(good), 0))
    return docs, labels


def held():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def test_held_out_accuracy_and_ranges(spark):
    docs, labels = corpus(400)
    docs += [(None, "no id", "en", 0.0), (1000, None, "en", 0.0), (1001, "", "en", 0.0), (1002, "long " * 40_000, "en", 0.0), (3, docs[3][1], "en", 0.0)]
    labels += [(None, 1, 0), (5, None, 0), (99_999, 0, 0), (6, 1, 0)]
    got = score_quality(spark.createDataFrame(docs, "doc_id long, text string, lang string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), held()).collect()
    assert len(got) == len(docs)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    truth = {i: g for i, g, _ in labels[:400]}
    out = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(out) > 40 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in out]) > 0.97


def test_held_out_labels_are_not_learned_from(spark):
    docs, labels = corpus(200)
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, score double")
    a = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    turned = a.withColumn("quality", F.when(held(), 1 - F.col("quality")).otherwise(F.col("quality")))
    rows = lambda x: sorted(score_quality(d, x, held()).collect())
    assert rows(a) == rows(turned)


def test_one_class_and_empty_tables(spark):
    docs, labels = corpus(30)
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert len({r["score"] for r in score_quality(d, none, held()).collect()}) == 1
    assert score_quality(d.limit(0), none, held()).count() == 0


def test_pairs_order_the_classes():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1, 1, (300, 3)), rng.normal(-1, 1, (50, 3))
    mean, spread, w = fit(good, bad)
    value = lambda x: ((x - mean) / spread) @ w
    assert (value(good)[:, None] > value(bad)[None]).mean() > 0.95
    assert np.array_equal(features(None), features(""))
