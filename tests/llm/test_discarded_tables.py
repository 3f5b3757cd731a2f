"""Written tables go when nothing reads them any more, so that a run's disk does not hold all of them at once."""

import os
import uuid

from pyspark.sql import functions as F

import corpus_pipeline as P
from scriptorium.llm import common, line_dedup


def tables(folder) -> set[str]:
    return {name.rsplit("-", 1)[0] for name in os.listdir(folder)}


def test_sets_and_lists_of_lines_are_gone_before_the_texts_move(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(common, "shared_path", lambda spark, name: f"file://{tmp_path}/{name}-{uuid.uuid4().hex}")
    words = [f"w{i}" for i in range(30)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "more"])), (2, "a b c"), (None, "a b c"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = line_dedup.dedup_lines(docs)
    assert not tables(tmp_path) & {"line-firsts", "line-lists", "line-posts", "line-sets"}
    assert sorted((r["doc_id"] or 0, r["text"], r["removed_lines"]) for r in out.collect() if r["text"] is not None) == [(0, "a b c", 0), (1, " ".join(words), 0), (2, "", 1), (2, "", 1)]


def test_rejected_rows_do_not_move_the_texts(spark):
    docs = spark.createDataFrame([(i, i, f"text {i % 3}", "en", "s", 6) for i in range(9)], "_row long, doc_id long, text string, lang string, source string, n_chars long")
    copies = docs.filter("_row > 2").select("_row")
    kept = common.without(docs, copies, "_row", "gone")
    assert sorted(r["_row"] for r in kept.collect()) == [0, 1, 2]
    assert "SortMergeJoin" not in kept._jdf.queryExecution().executedPlan().toString()


def test_a_long_list_is_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_IDS", 2)
    docs = spark.range(9).select(F.col("id").alias("_row"))
    kept = common.without(docs, docs.filter("_row > 2"), "_row", "gone")
    assert sorted(r["_row"] for r in kept.collect()) == [0, 1, 2]


def test_near_copies_go_by_row(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(0, 7, text, "en", "s", 1), (1, 7, text, "en", "s", 1), (2, None, "other words here", "en", "s", 1)], "_row long, doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["_row"] for r in P.near_copies(spark, docs, "").collect()) == [0, 2]
