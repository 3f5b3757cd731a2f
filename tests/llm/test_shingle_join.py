import random

import pytest

from scriptorium.llm import shingle_join
from scriptorium.llm.graph import components
from scriptorium.llm.shingle_join import jaccard_components


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [(i, shingles(t)) for i, t, *_ in rows]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                i_, j_ = sorted((root(i), root(j)))
                parent[j_] = i_
    return sorted((i, len(s), root(i)) for i, s in sets)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randint(0, 10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("hot", [64, 4])
def test_equals_brute_force(spark, monkeypatch, hot):
    # With few sets a list counts as hot, and answers are taken over.
    monkeypatch.setattr(shingle_join, "HOT", hot)
    rng = random.Random(hot)
    common = [f"licence{i}" for i in range(30)]
    rows = []
    for g in range(6):
        base = [f"g{g}w{rng.randint(0, 400)}" for _ in range(rng.randint(40, 160))]
        rows += [edited(rng, base, rng.randint(0, 6)) for _ in range(25)] + [" ".join(base + base[:k]) for k in (10, 30)]
    rows += [" ".join(common + [f"u{i}x{k}" for k in range(rng.randint(1, 60))]) for i in range(60)]
    rows += [None, "", "   ", "one", "ONE", "a b c d", "a b  c\td", "a b c d e", "É x", "é x", "rep " * 30_000, "rep " * 29_000] + [" ".join(common)] * 30
    rng.shuffle(rows)
    data = [(i * 3 - 100, t, i, "z") for i, t in enumerate(rows)]
    docs = spark.createDataFrame(data, "doc_id long, text string, n int, token string").repartition(6)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_components(docs).collect())
    assert got == brute(data)


def test_null_ids_repeats_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (9, "q"), (9, "q"), (10, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_components(docs).collect()), key=str)
    assert got == sorted([(None, 2, None), (4, 2, None), (9, 1, 9), (9, 1, 9), (10, 0, 10)], key=str)
    assert jaccard_components(docs.limit(0)).count() == 0


def test_repeated_ids_with_other_texts_keep_their_links(spark):
    a, b = ([f"{x}{i}" for i in range(30)] for x in "ab")
    near = " ".join(b[:-1] + ["end"])
    data = [(1, " ".join(a)), (5, " ".join(a)), (5, " ".join(b)), (9, near), (5, ""), (7, "z " * 9), (7, "y"), (3, "y"), (2, "w x"), (2, "w x"), (8, "w  X")]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_components(spark.createDataFrame(data, "doc_id long, text string")).collect())
    assert got == brute(data)
    assert (9, len(shingles(near)), 1) in got


def test_null_ids_are_not_one_node(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    data = [(None, a)] * 3 + [(None, b), (None, a + " more"), (4, b + " end"), (6, "q r s"), (7, "Q r s"), (8, "alone")]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_components(docs).collect()}
    assert got == {None: None, 4: None, 6: 6, 7: 6, 8: 8}
    # Copies of unrelated texts without id, between rows with ids: the links of either text stay.
    rows = [(1, a), (None, a), (None, b), (2, b)]
    linked = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert linked.count() == 4 and linked.filter("component_id IS NULL").count() == 4


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 95)], "a long, b long")
    got = {r["id"]: r["component"] for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 90, 90: 90, 95: 90}
