import random

import duckdb

from scriptorium.llm.line_dedup import dedup_lines
from scriptorium.llm.queries import ORACLE


def reference(rows):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    return sorted(con.execute(ORACLE["op5_line_dedup"]).fetchall())


def test_equals_sql(spark):
    rng = random.Random(6)
    bases = [[f"b{b}x{rng.randint(0, 999)}" for _ in range(rng.randint(3, 60))] for b in range(12)]

    def line():
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(len(words))] = f"e{rng.randint(0, 99)}"
        return rng.choice(["", " "]) + rng.choice([" ", "  "]).join(words)

    rows = [(i, "\n".join(rng.choice([line(), line(), "", "tiny", "a b"]) for _ in range(rng.randint(1, 9)))) for i in range(120)]
    rows += [(500, ""), (501, "\n\n"), (502, "word " * 20_000), (503, "word " * 20_000 + "\nend of it")]
    docs = spark.createDataFrame([(*r, 7, "k") for r in rows], "doc_id long, text string, removed_lines int, ref string").repartition(4)
    out = dedup_lines(docs)
    got = sorted((r["doc_id"], r["removed_lines"], r["text"]) for r in out.collect())
    assert got == sorted((i, n, t) for i, t, n in reference(rows))
    assert out.columns == ["doc_id", "text", "removed_lines", "ref"]


def test_nulls_repeated_ids_and_empty(spark):
    docs = spark.createDataFrame([(None, "x y\nx y"), (1, None), (2, "x y"), (3, "k l m"), (3, "k l m"), (3, "other\nx y")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["text"]) for r in dedup_lines(docs).collect()), key=str)
    assert got == sorted([(None, "x y"), (1, None), (2, ""), (3, "k l m"), (3, "k l m"), (3, "other")], key=str)
    assert dedup_lines(docs.limit(0)).count() == 0


def test_near_copies_whose_first_line_matches_only_some(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]

    def near(edits):
        words = list(base)
        for at in rng.sample(range(60), edits):
            words[at] = f"e{rng.randint(0, 9999)}"
        return " ".join(words)

    rows = [(None if i == 3 else i, "\n".join(near(rng.choice([1, 1, 2, 3])) for _ in range(2))) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {(r["doc_id"], r["removed_lines"], r["text"]) for r in dedup_lines(docs).collect()}
    # Null ids are one document before all others.
    known = {i: n for n, i in enumerate(sorted(i for i, _ in rows if i is not None), 1)} | {None: 0}
    back = {n: i for i, n in known.items()}
    assert got == {(back[i], n, t) for i, t, n in reference([(known[i], t) for i, t in rows])}
    assert 60 < sum(n for _, n, _ in got) < 180


def test_words_of_lines_with_any_blanks(spark):
    import re

    from pyspark.sql import functions as F

    from scriptorium.llm.line_dedup import line_words

    lines = ["a b c", " a b", "a b ", "a  b", "a\tb c", "a\x0bb", "a\x0cb\r", "one", " one ", "é\x85x y\x1cz", "a \t b"]
    got = spark.createDataFrame([(x,) for x in lines], "line string").select("line", line_words(F.col("line")).alias("w")).collect()
    assert {r["line"]: r["w"] for r in got} == {x: re.findall(r"[^\x20\x09-\x0D]+", x) for x in lines}
    # The regular expression is left to lines that need it: both ways stand in the plan.
    assert line_words(F.lit("a b"))._jc.toString().count("split(") == 2
