import heapq
import random
import zlib

from pyspark.sql import functions as F

from scriptorium.llm.sharding import schedule, shard_documents


def lpt(sizes, shards):
    heap = [(0, s) for s in range(shards)]
    for size in sorted(sizes, reverse=True):
        load, s = heapq.heappop(heap)
        heapq.heappush(heap, (load + size, s))
    return sorted(load for load, _ in heap)


def test_schedule_equals_plain_lpt():
    rng = random.Random(5)
    for case in range(30):
        shards = rng.randint(1, 9)
        sizes = [rng.choice([1, 2, 3, 7, 50, rng.randint(1, 400)]) for _ in range(rng.randint(0, 300))] + [9000] * (case % 3)
        classes = [(s, sizes.count(s), s * sizes.count(s)) for s in set(sizes)]
        plan = schedule(classes, shards)
        loads = sorted(sum(plan[c][s] * c for c in plan) for s in range(shards))
        assert loads == lpt(sizes, shards)


def test_groups_stay_together_and_slots_have_no_gaps(spark):
    rng = random.Random(2)
    texts = [None, "", "é" * 9, "same"] + ["w" * rng.randint(0, 90) + str(i) for i in range(120)]
    rows = [(i, texts[i % 124], i) for i in range(300)] + [(7, "same", 1)] * 40 + [(None, "x" * 50_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = shard_documents(docs, 4).collect()
    assert len(got) == len(rows)
    sizes, where = {}, {}
    for i, t, _ in rows:
        sizes[t or ""] = sizes.get(t or "", 0) + len((t or "").encode()) + 1
    by_crc = {zlib.crc32(t.encode()): t for t in sizes}
    loads = [0] * 4
    for r in got:
        loads[r["shard"]] += r["size"]
        where.setdefault(by_crc[r["text_crc32"]], set()).add(r["shard"])
    assert all(len(s) == 1 for s in where.values())
    assert sorted(loads) == lpt(sizes.values(), 4)
    for s in range(4):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_empty_table(spark):
    assert shard_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_reruns_agree(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a"), (F.col("id") % 13).cast("int")).alias("text"))
    assert sorted(shard_documents(docs, 3).collect()) == sorted(shard_documents(docs.repartition(5), 3).collect())
