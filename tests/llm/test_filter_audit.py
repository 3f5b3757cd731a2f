import random
import re
from collections import defaultdict
from itertools import permutations

import pytest

from scriptorium.llm.filter_audit import audit_documents, audit_filters

COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute(docs, labels):
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    rows = []
    for i, text, lang in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        copied = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), copied]
        rows.append((lang or "", {c for c, f in zip("ABCDE", fails, strict=True) if f}, i))
    out, shapley = {}, defaultdict(int)
    for part in {r[0] for r in rows}:
        for order in map("".join, permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            gone = []
            for step, c in enumerate(order, 1):
                here = [r for r in left if c in r[1]]
                lost = lambda ids, here=here: sum(r[2] in ids for r in here)
                left = [r for r in left if c not in r[1]]
                alone = sum(r[1] == {c} for r in rows if r[0] == part)
                out[part, order, step] = [len(left), len(here), sum(c in r[1] for r in gone), alone, lost(good - {None}), lost(toxic - {None})]
                gone += here
                shapley[part, c] += len(here)
    return {k: [*v, shapley[k[0], k[1][k[2] - 1]]] for k, v in out.items()}


def got(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in COUNTS] for r in df.collect()}


def test_equals_brute_force(spark):
    rng = random.Random(4)

    def text():
        words = [rng.choice(["alpha", "Beta", "é", "d"]) if rng.random() < 0.5 else f"w{rng.randrange(10**6)}" for _ in range(rng.choice([0, 3, 150, 199, 200, 260]))]
        return rng.choice([" ", "\t", "\n \n"]).join(words) + rng.choice(["", "", "#", " 5 %", "AAAA BBBB CCCC" * 9])

    docs = [(i, text(), rng.choice(["en", "de", "", None])) for i in range(60)]
    docs += [(100 + i, rng.choice(docs)[1], rng.choice(["en", "de"])) for i in range(40)]
    docs += [(200, None, "en"), (201, "", "fr"), (None, docs[0][1], "en"), (None, docs[0][1], "en"), (3, docs[5][1], "en"), (3, docs[3][1], "de"), (300, "word " * 50_000, "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 140, 2)] + [(4, 1, 0), (None, 1, 1)]
    left = spark.createDataFrame([(*d, True, 5) for d in docs], "doc_id long, text string, lang string, good boolean, n int").repartition(5)
    right = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    merged = defaultdict(lambda: [0, 0])
    for i, q, t in labels:
        merged[i] = [max(merged[i][0], q or 0), max(merged[i][1], t or 0)]
    out = audit_documents(left, right)
    assert got(out) == brute(docs, [(i, *v) for i, v in merged.items()])
    assert out.count() == 600 * len({d[2] or "" for d in docs})
    assert audit_documents(left.limit(0), right).count() == 0
    assert audit_documents(left, right.limit(0)).agg({"good_lost": "sum"}).first()[0] == 0


def test_other_filters(spark):
    rows = spark.createDataFrame([("p", [True, True], 2, 1), ("p", [False, True], 3, 1), ("p", [False, False], 5, 0)], "part string, fails array<boolean>, n long, w long")
    out = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["lost"], r["shapley"]) for r in audit_filters(rows, "XY", {"lost": "w"}).collect()}
    assert out == {("XY", 1): (8, 2, 0, 0, 1, 2), ("XY", 2): (5, 3, 2, 3, 1, 8), ("YX", 1): (5, 5, 0, 3, 2, 8), ("YX", 2): (5, 0, 2, 0, 0, 2)}
    with pytest.raises(ValueError):
        audit_filters(rows, "XX", {})
