import random
import re

import xxhash
from pyspark.sql import functions as F

from scriptorium.llm.syncmers import K, PLACE_BITS, S, SIZE, anchor_matches, anchors, compare_with_edits, likeness, places


def hash_of(*values):
    """Spark's xxhash64: each value hashed with the hash before it as seed."""
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else v.to_bytes(8, "little")
        seed = xxhash.xxh64(data, seed=seed).intdigest()
    return seed


def plain(text):
    words = re.split(r"[\x20\x09-\x0D]+", text or "")
    pack = lambda h, i: (h >> (PLACE_BITS + 1)) << PLACE_BITS | i
    if len(words) < K:
        return [pack(hash_of(*words), 0)]
    found = {}
    for i in range(len(words) - K + 1):
        # Spark compares hashes as signed numbers.
        inner = [hash_of(*words[i + j : i + j + S]) for j in range(K - S + 1)]
        signed = [h - (1 << 64) if h >> 63 else h for h in inner]
        if min(signed) in (signed[0], signed[-1]):
            a = pack(hash_of(inner[0], inner[2]), i)
            found.setdefault(a >> PLACE_BITS, a)
    return sorted(found.values())[:SIZE] or [pack(hash_of(*words), 0)]


def dice(a, b):
    a, b = {x >> PLACE_BITS for x in a}, {x >> PLACE_BITS for x in b}
    low = sorted(a | b)[:SIZE]
    j = sum(x in a and x in b for x in low) / len(low)
    return 2 * j / (1 + j)


def text(rng, n):
    return " ".join(rng.choice(["the", "of", "rain", "falls", "over", "städte", "and", "x" * rng.randint(1, 9)]) for _ in range(n))


def test_equals_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", "one", " lead  and\ttrail ", "a b c", "a b c d", "of " * 400, "x" * 30_000] + [f"a{i} b c d" for i in range(9)] + [text(rng, rng.randint(1, 600)) for _ in range(60)]
    rows = [(3 * i - 40, t, 1.0) for i, t in enumerate(texts)] + [(None, "null id text here now", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, near_next double").repartition(5)
    got = {r["doc_id"]: r for r in compare_with_edits(docs).collect()}
    assert len(got) == len(rows)
    order = sorted(rows[:-1], reverse=True) + rows[-1:]
    for (i, t, _), (_, after, _) in zip(order, order[1:] + order[:1], strict=True):
        t, after = t or "", after or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[i]
        assert (r["n_chars"], r["edited"]) == (len(t), edited)
        assert r["anchors"] == plain(t) and r["edited_anchors"] == plain(edited)
        assert abs(r["near_edited"] - dice(plain(t), plain(edited))) < 1e-12
        assert abs(r["near_next"] - dice(plain(t), plain(after))) < 1e-12


def test_half_of_a_long_text_stays_alike(spark):
    rng = random.Random(8)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(4000)]
    other = [f"v{rng.randint(0, 10**6)}" for _ in range(4000)]
    docs = spark.createDataFrame([(2, " ".join(words)), (1, " ".join(other))], "doc_id long, text string")
    for r in compare_with_edits(docs).collect():
        assert 0.3 < r["near_edited"] < 0.7 and r["near_next"] < 0.05


def test_repeated_ids_single_row_and_empty(spark):
    docs = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (4, "q r s t u v")], "doc_id long, text string")
    got = compare_with_edits(docs).collect()
    assert sorted(r["doc_id"] for r in got) == [4, 5, 5]
    assert len({(r["doc_id"], r["edited"]) for r in got}) == 2
    (only,) = compare_with_edits(docs.filter("doc_id = 4")).collect()
    assert only["near_next"] == 1 and only["edited"] == "q r s q r s"[:6] + "q r s"
    assert compare_with_edits(docs.limit(0)).count() == 0


def test_matches_give_places(spark):
    df = spark.createDataFrame([("k a b c d e f g", "z z k a b c d e f g")], "x string, y string").select(anchors(F.col("x")).alias("x"), anchors(F.col("y")).alias("y"))
    (r,) = df.select(anchor_matches(F.col("x"), F.col("y")).alias("m"), likeness(F.col("x"), F.col("y")).alias("l")).collect()
    assert r["m"] and all(p["in_b"] - p["in_a"] == 2 for p in r["m"]) and 0 < r["l"] <= 1


def test_a_passage_is_found_between_long_texts(spark):
    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    passage, long, longer = fresh(60), fresh(1500), fresh(4000)
    long[700:700], longer[3000:3000] = passage, passage
    df = spark.createDataFrame([(" ".join(long), " ".join(longer))], "x string, y string").select(places(F.col("x")).alias("x"), places(F.col("y")).alias("y"))
    (r,) = df.select("x", "y", anchor_matches(F.col("x"), F.col("y")).alias("m"), likeness(F.col("x"), F.col("y")).alias("l")).collect()
    assert len(r["x"]) > 800 and len(r["y"]) > 2200
    assert len(r["m"]) > 20 and all(p["in_b"] - p["in_a"] == 2300 for p in r["m"])
    assert abs(r["l"] - 2 * len(r["m"]) / (len(r["x"]) + len(r["y"]))) < 1e-12


def test_every_place_of_a_repeated_anchor_stays(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j " * 30)], "doc_id long, text string")
    (r,) = compare_with_edits(docs).collect()
    assert len(r["anchors"]) <= 13 and len(r["places"]) >= 29 * 4
    assert {a >> PLACE_BITS for a in r["places"]} == {a >> PLACE_BITS for a in r["anchors"]}
    assert r["near_next"] == 1
