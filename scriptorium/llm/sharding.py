"""Sharding by longest-processing-time scheduling.

Documents with equal texts form a group that stays together.  Groups, largest
first, go to the least-loaded shard through a heap.  The schedule depends only
on the groups' sizes, and groups of one size are interchangeable, so the heap
runs over a histogram of sizes instead of the groups: sizes share a class when
their 12 leading bits agree (a bounded table, about 110,000 rows for any
corpus), a class's groups count with their mean size, and a run of equal groups
is dealt out in whole rounds.  The result says how many groups of each class a
shard takes; the groups' ranks inside the class then pick the shard.
"""

from __future__ import annotations

import heapq
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import numbered, staged

LEADING_BITS = 12


def schedule(classes: list[tuple[int, int, int]], shards: int) -> dict[int, list[int]]:
    """Groups per shard for each size class; ``classes``: (class, groups, bytes of all of them)."""
    heap = [(0.0, s) for s in range(shards)]
    taken = {}
    for cls, groups, total in sorted(classes, key=lambda c: -c[2] / c[1]):
        size, left, counts = total / groups, groups, [0] * shards
        while left:
            level = sorted(heap)
            near = sum(load <= level[0][0] + size for load, _ in level)
            room = (level[near][0] - level[near - 1][0]) // size if near < shards else left
            rounds = int(min(left // near, room))
            if rounds:
                heap = [(load + rounds * size, s) if i < near else (load, s) for i, (load, s) in enumerate(level)]
                heapq.heapify(heap)
                for _, s in level[:near]:
                    counts[s] += rounds
                left -= rounds * near
            else:
                load, s = heapq.heappop(heap)
                heapq.heappush(heap, (load + size, s))
                counts[s] += 1
                left -= 1
        taken[cls] = counts
    return taken


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row of ``docs`` into a shard.

    Returns doc_id, size (UTF-8 bytes plus 1), text_crc32, shard and slot
    (gapless from 0 in each shard).  A null text counts as empty and shares the
    group of the empty texts.  Repeated rows and null ids are rows like others;
    an empty table gives an empty result.  Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = staged(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.md5(text.cast("binary"))).alias("key"),
        ),
        "shard-rows",
    )
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    groups = groups.withColumn("_low", F.greatest(F.length(F.bin("bytes")) - LEADING_BITS, F.lit(0)))
    groups = staged(groups.withColumn("cls", F.expr("shiftleft(shiftright(bytes, _low), _low)")).drop("_low"), "shard-groups")
    classes = groups.groupBy("cls").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).collect()
    plan = [(c, list(accumulate(n))) for c, n in schedule([tuple(r) for r in classes], shards).items()]
    cuts = docs.sparkSession.createDataFrame(plan, "cls long, upto array<long>")
    placed = numbered(groups, ["cls"], ["key"], "rank").join(cuts, "cls")
    placed = placed.select("key", F.size(F.filter("upto", lambda c: c <= F.col("rank"))).alias("shard"))
    out = staged(rows.join(placed, "key").select("doc_id", "size", "text_crc32", "shard"), "shard-placed")
    return numbered(out, ["shard"], ["doc_id", "text_crc32", "size"], "slot")
