"""Mixing sources to target weights with hash-threshold histograms.

Every document has a fixed 60-bit hash.  A source's target is some whole
repeats of all its documents plus a remainder; the documents below a hash
threshold make up the remainder.  The threshold comes from histograms: words by
source and the hash's leading 12 bits, then only inside the bucket where the
budget runs out the next 12 bits, and so on until that bucket holds one hash.
No row is sorted, a smaller budget keeps a subset of a larger one's documents,
and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import WORD, staged

HASH_BITS, DIGIT_BITS = 60, 12
# Above this number of sources the table of thresholds is joined by shuffle.
BROADCAST_SOURCES = 65_536


def source_targets(sizes: DataFrame, weights: tuple[int, ...], most: float) -> DataFrame:
    """Targets by source: weight times one level, at most ``most`` times the source's size.

    ``sizes``: source, source_size, weight.  The level rises by what capped
    sources leave over until no further source is above its cap.
    """
    capped, level = -1, 0.0
    while True:
        over = F.col("source_size") * most <= F.col("weight") * level
        r = sizes.agg(
            F.sum("source_size").alias("total"),
            F.count_if(over).alias("capped"),
            F.sum(F.when(over, F.col("source_size") * most)).alias("full"),
            F.sum(F.when(~over, F.col("weight"))).alias("weight"),
        ).first()
        if r["capped"] == capped or not r["weight"]:
            break
        capped, level = r["capped"], ((r["total"] or 0) - (r["full"] or 0)) / r["weight"]
    return sizes.withColumn("target", F.least(F.col("source_size") * F.lit(float(most)), F.col("weight") * F.lit(float(level))))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """How many words the mix takes of every row of ``docs``.

    Returns doc_id, source, size (words), source_size, target (the source's),
    repeats (whole copies taken) and taken (size times repeats).  Sources in
    code point order, null last, weigh ``weights`` in turn.  A source's taken
    words differ from its target by at most half of one document (rows that
    repeat a doc_id share its hash and are taken together).  A null text has no
    words, a null source is a source, an empty table gives an empty result.
    ``row_col``: a column to return too, as a key of the row.  Other columns are
    not read.
    """
    row = [row_col] if row_col else []
    rows = staged(
        docs.select(
            *row,
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long").alias("hash"),
        ),
        "mix-rows",
    )
    # One row a source: ordered as a whole only to deal out the weights.
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("sid", F.row_number().over(by_name) - 1)
    sources = staged(sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int"))), "mix-sources")
    few = sources.count() <= BROADCAST_SOURCES
    small = F.broadcast if few else (lambda df: df)
    targets = source_targets(sources, weights, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = staged(targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets")

    keyed = rows.join(small(targets.select("source", "sid")), rows["source"].eqNullSafe(targets["source"])).select("sid", "size", "hash")
    cut = targets.select("sid", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(None).cast("long").alias("only"))
    for level in range(1, HASH_BITS // DIGIT_BITS + 1):
        low = HASH_BITS - level * DIGIT_BITS
        inside = keyed.join(small(cut.filter("only IS NULL")), "sid").filter(F.shiftright("hash", low + DIGIT_BITS) == F.col("prefix"))
        bins = inside.groupBy("sid", "rest", F.shiftright("hash", low).alias("bin")).agg(
            F.sum("size").alias("words"), F.min("hash").alias("lo"), F.max("hash").alias("hi")
        )
        upto = Window.partitionBy("sid").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        bins = bins.withColumn("upto", F.sum("words").over(upto))
        edge = bins.filter((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") <= F.col("rest")))
        found = edge.select("sid", (F.col("rest") - F.col("upto") + F.col("words")).alias("rest"), F.col("bin").alias("prefix"),
                            F.when((F.col("lo") == F.col("hi")), F.col("lo")).alias("only"), "words")
        cut = staged(found.unionByName(cut.filter("only IS NOT NULL"), allowMissingColumns=True), "mix-cut")
        if not cut.filter("only IS NULL").head(1):
            break
    # The boundary hash is in if that comes nearer to the target.
    limits = cut.select("sid", (F.col("only") + (F.col("rest") * 2 >= F.col("words")).cast("long")).alias("below"))
    table = targets.join(limits, "sid", "left").select(F.col("source").alias("_source"), "source_size", "target", "whole", "below")
    out = rows.join(small(table), rows["source"].eqNullSafe(table["_source"]))
    repeats = F.col("whole") + F.coalesce((F.col("hash") < F.col("below")).cast("long"), F.lit(0).cast("long"))
    return out.select(*row, "doc_id", "source", "size", "source_size", "target", repeats.alias("repeats"), (repeats * F.col("size")).alias("taken"))
