"""Document fingerprints from closed syncmers of words, as built-in functions only.

A k-mer is K consecutive words, an inner substring S consecutive words of it.
A k-mer is a closed syncmer, and so an anchor, if the smallest hash among its
inner substrings lies at its first or last place (equal hashes count).  That
depends on the k-mer alone, so an edit touches only the anchors it overlaps.
The fingerprint keeps every anchor at every word position; likeness compares the
whole sets.  With a ``size``, a sketch of the smallest hashes by the usual
bottom-k rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.arrays import let
from scriptorium.llm.common import staged

# SIZE: anchors a fingerprint keeps; None is all of them.
K, S, SIZE = 4, 2, None
# An anchor is one number: its hash's upper 39 bits, then 24 bits of position.
PLACE_BITS = 24
SPACE = r"[\x20\x09-\x0D]+"


def _whole(words: Column) -> Column:
    """The only anchor of a text without closed syncmers: all its words, at 0."""
    return F.array(_packed(F.xxhash64(words), F.lit(0)))


def _packed(value: Column, place: Column) -> Column:
    kept = F.shiftleft(F.shiftrightunsigned(value, PLACE_BITS + 1), PLACE_BITS)
    return kept.bitwiseOR(F.least(place, F.lit((1 << PLACE_BITS) - 1)).cast("long"))


def places(text: Column, k: int = K, s: int = S) -> Column:
    """All anchors of a text at all their places as sorted numbers, hash above position; null is empty."""

    def inner(words: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(words) - (s - 1)), lambda i: F.xxhash64(*[F.get(words, i + (j - 1)) for j in range(s)]))

    def chosen(hashes: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(hashes) - (k - s + 1))

        def anchor(i: Column) -> Column:
            parts = [F.get(hashes, i + j) for j in range(k - s + 1)]
            least = F.least(*parts)
            # Inner substrings that overlap the first one need not be hashed again.
            ends = sorted({*range(0, k - s, s), k - s})
            return F.when((parts[0] == least) | (parts[-1] == least), _packed(F.xxhash64(*[parts[e] for e in ends]), i))

        return F.array_compact(F.transform(places, anchor))

    def mark(words: Column) -> Column:
        found = let(let(inner(words), chosen), lambda a: F.sort_array(a))
        some = let(found, lambda a: F.when(F.size(a) == 0, _whole(words)).otherwise(a))
        return F.when(F.size(words) < k, _whole(words)).otherwise(some)

    return let(F.split(F.coalesce(text, F.lit("")), SPACE), mark)


def first_places(every: Column, size: int | None = SIZE) -> Column:
    """Each anchor of ``places`` once, at its first place; with a ``size`` those of the smallest hashes."""
    once = F.filter(every, lambda a, i: (i == 0) | (_hash(a) != _hash(F.get(every, i - 1))))
    return F.slice(once, 1, size) if size else once


def anchors(text: Column, k: int = K, s: int = S, size: int | None = SIZE) -> Column:
    """The set of a text's anchors, each at its first place."""
    return let(places(text, k, s), lambda every: first_places(every, size))


def _hash(anchor: Column) -> Column:
    return F.shiftright(anchor, PLACE_BITS)


def fingerprint_text(a: Column) -> Column:
    """Anchors as text: 16 hexadecimal digits each."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def likeness(a: Column, b: Column, size: int | None = SIZE) -> Column:
    """Share of anchors two fingerprints have in common: 2 J / (1 + J), J the Jaccard of their sets (with a ``size`` the bottom-k estimate)."""
    hashes = lambda x: F.transform(x, _hash)

    def compare(x: Column, y: Column) -> Column:
        if not size:
            return _dice(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))
        lowest = let(F.array_union(x, y), lambda u: F.slice(F.sort_array(u), 1, size))
        return let(lowest, lambda u: _dice(F.size(F.filter(F.array_intersect(x, y), lambda h: h <= F.element_at(u, -1))) / F.size(u)))

    return let(hashes(a), lambda x: let(hashes(b), lambda y: compare(x, y)))


def _dice(j: Column) -> Column:
    return 2 * j / (1 + j)


def anchor_matches(a: Column, b: Column) -> Column:
    """Positions (in_a, in_b) of the anchors that two fingerprints share."""
    place = lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    pairs = F.flatten(F.transform(a, lambda x: F.transform(F.filter(b, lambda y: _hash(x) == _hash(y)), lambda y: F.struct(place(x).alias("in_a"), place(y).alias("in_b")))))
    return F.array_sort(pairs)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, s: int = S, size: int | None = SIZE) -> DataFrame:
    """doc_id and anchors of every row; null and empty texts have the same one anchor."""
    return docs.select(F.col(id_col).alias("doc_id"), anchors(F.col(text_col), k, s, size).alias("anchors"))


def next_ids(ids: DataFrame) -> DataFrame:
    """For every distinct doc_id the next one in descending order (after the last: the first; null is last).

    Ranges of ids are ordered inside their partition; only the first id of each
    range is ordered as a whole.
    """
    down = F.col("doc_id").desc_nulls_last()
    dealt = ids.select("doc_id").distinct().repartitionByRange(down).sortWithinPartitions(down)
    dealt = staged(dealt.withColumn("part", F.spark_partition_id()), "syncmer-ids")
    inside = Window.partitionBy("part").orderBy(down)
    ranked = dealt.withColumn("at", F.row_number().over(inside)).withColumn("left", F.count("*").over(Window.partitionBy("part")) - F.col("at"))
    ranked = ranked.withColumn("inside_next", F.lead("doc_id").over(inside))
    heads = ranked.filter("at = 1").select("part", "doc_id").sort("part").collect()  # one row a partition
    after = [(h["part"], heads[(i + 1) % len(heads)]["doc_id"]) for i, h in enumerate(heads)]
    heads = ids.sparkSession.createDataFrame(after, f"_part int, head {ids.schema['doc_id'].dataType.simpleString()}")
    out = ranked.join(heads, ranked["part"] == heads["_part"])
    return out.select("doc_id", F.when(F.col("left") > 0, F.col("inside_next")).otherwise(F.col("head")).alias("next_id"))


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, s: int = S) -> DataFrame:
    """Fingerprints of every text and of its edited text, and what they have in common.

    The edited text: the last half of the code points replaced by as many first
    ones of the next document in descending id order.  Returns doc_id, n_chars,
    edited, anchors, edited_anchors (sets, at first places), places,
    edited_places (all places), near_edited, near_next (of the whole sets).  A
    null text is empty.  Rows that repeat an id have the same next document; of a
    repeated id, the smallest text is the next one.  Null ids come last.  A
    single document is its own next.  Other columns are not read.
    """
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Texts travel, their anchors are made where they are compared: all anchors are larger than the text.
    base = docs.select(F.col(id_col).alias("doc_id"), key(id_col).alias("key"), text.alias("text"))
    base = base.repartition("key")  # one exchange of the texts for both sides of the join
    order = staged(next_ids(docs.select(F.col(id_col).alias("doc_id"))), "syncmer-next")
    order = order.select(key("doc_id").alias("for_key"), key("next_id").alias("key"))

    # Ordered by doc_id too, so that both sides read the same columns and share the exchange.
    first = Window.partitionBy("key").orderBy("text", "doc_id")
    one = base.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("key", "text")
    after = one.join(order, "key").select(F.col("for_key").alias("key"), F.col("text").alias("after"))

    rows = base.join(after, "key")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("after", F.lit(1), half))
    made = F.struct(n.cast("long").alias("n_chars"), edited.alias("edited"), places(F.col("text"), k, s).alias("places"), places(edited, k, s).alias("edited_places"), places(F.col("after"), k, s).alias("after"))

    def compared(m: Column) -> Column:
        return F.struct(
            m["n_chars"].alias("n_chars"), m["edited"].alias("edited"),
            first_places(m["places"], None).alias("anchors"), first_places(m["edited_places"], None).alias("edited_anchors"),
            m["places"].alias("places"), m["edited_places"].alias("edited_places"),
            likeness(m["places"], m["edited_places"], None).alias("near_edited"),
            likeness(m["places"], m["after"], None).alias("near_next"),
        )

    return rows.select("doc_id", let(made, compared).alias("r")).select("doc_id", "r.*")
