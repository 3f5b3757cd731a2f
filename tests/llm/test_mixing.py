import duckdb
import pytest

from scriptorium.llm.mixing import mix
from scriptorium.llm.queries import ORACLE

ROWS = (
    [(i, "w " * (i % 17) + "x" * (i % 3), "abc"[i % 3]) for i in range(200)]
    + [(1000 + i, "word " * 900, "big") for i in range(60)]
    + [(3000, "long one " * 20_000, "one"), (None, "a b", None), (4000, None, None), (4001, "", "void"), (5000, "q r s", "dup"), (5000, "q r s", "dup")]
)


def reference(rows):
    documents = duckdb.connect()
    documents.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    documents.executemany("insert into documents values (?, ?, ?)", rows)
    return documents.execute(ORACLE["op3_mix"]).fetchall()


def test_equals_sql_and_comes_near_targets(spark):
    docs = spark.createDataFrame([(*r, 1, "k") for r in ROWS], "doc_id long, text string, source string, taken int, sid string")
    got = mix(docs).collect()
    key = lambda r: tuple(str(x) for x in r)
    mine = sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in got), key=key)
    assert mine == sorted(((a, b, c, round(float(d), 6), e) for a, b, c, d, e in reference(ROWS)), key=key)
    for source in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in own)


def test_targets_share_all_words_when_no_cap_binds(spark):
    docs = spark.createDataFrame([(i, "a b c d", "xyz"[i % 3]) for i in range(90)], "doc_id long, text string, source string")
    got = {r["source"]: r["target"] for r in mix(docs).collect()}
    assert got == pytest.approx({"x": 60, "y": 120, "z": 180})


def test_budgets_nest(spark):
    docs = spark.createDataFrame([(i, "a " * (1 + i % 5), "xy"[i % 2]) for i in range(400)], "doc_id long, text string, source string")
    less = {r["doc_id"]: r["taken"] for r in mix(docs, (1, 4)).filter("source = 'x'").collect()}
    more = {r["doc_id"]: r["taken"] for r in mix(docs, (2, 4)).filter("source = 'x'").collect()}
    assert all(less[i] <= more[i] for i in less) and sum(less.values()) < sum(more.values())


def test_empty_table(spark):
    assert mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
