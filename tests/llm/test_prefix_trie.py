import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from scriptorium.llm import prefix_trie as P
from scriptorium.llm.prefix_trie import prefix_trie


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in children[node]) if children[node] else 1
        saved[node] = sum(saved[k] for k in children[node]) + (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(built[c]) == len(node)))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def conversations(rng, n=120):
    rows = []
    for c in rng.sample(range(400), n):
        for t in range(rng.randint(1, 12)):
            rows.append((c, t, rng.choice(["user", "bot", None]), rng.choice(["hi", "é", "", "ok", None])))
    long = [(405, t, "user", f"w{t % 7}") for t in range(300)] + [(406, t, "user", f"w{t % 7}") for t in range(280)] + [(407, 0, "user", "x")]
    odd = [(410, None, "user", "null first"), (410, 1, "user", "b"), (410, 1, "user", "a"), (410, 1, "user", "a"), (None, 1, "user", "lost"), (12345678901, 0, "ab", "c"), (12345678902, 0, "a", "bc")]
    rows += long + odd
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("partitions, ends", [(1, 4096), (9, 7)])
def test_equals_brute_force(spark, monkeypatch, partitions, ends):
    monkeypatch.setattr(P, "ENDS", ends)
    rows = conversations(random.Random(partitions))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    # Long conversations lie in several range partitions.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = spark.createDataFrame([(*r, 3, "n") for r in rows], "conv_id long, turn long, role string, text string, depth int, conv string").repartition(partitions)
        assert got(prefix_trie(turns)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_collisions_draw_new_residues(spark, monkeypatch):
    rows = [(c, t, "user", f"{c * t % 4}") for c in range(30) for t in range(12)]
    turns = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    plain = P.Residues.turn
    monkeypatch.setattr(P.Residues, "turn", lambda self, i: F.lit(5).cast("long") if self.seed == 0 else plain(self, i))
    assert got(prefix_trie(turns)) == brute(rows)
    with pytest.raises(RuntimeError):
        prefix_trie(turns, seeds=range(1))


def test_empty_table(spark):
    assert prefix_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
