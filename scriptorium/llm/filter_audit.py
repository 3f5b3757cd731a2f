"""Filter interaction audit: what each filter removes at each place of every order of the filters.

A document is a row of a mask matrix: 0 where it fails a filter, infinity (one
more than the number of filters) where it passes.  An order is a column of a
position matrix, the inverse permutation: the step at which each filter runs.
Their min-plus product is the removal step of the document under the order;
documents that no filter removes get a step after the last.  The steps then
drive weighted counts by (part, order, step).

Documents of one part that fail the same filters are equal rows of the mask
matrix, so the product is taken once for each such class, with its document
counts as weights: at most 2^n classes a part, whatever the corpus holds.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.arrays import let

SPACE = r"[\x20\x09-\x0D]+"
MOST_FILTERS = 7


def orders_of(letters: str) -> Column:
    """A constant array: every order of ``letters``."""
    return F.array(*[F.lit("".join(p)) for p in permutations(letters)])


def positions(order: Column, letters: str) -> Column:
    """The inverse permutation: the step (from 1) of each letter, by letter."""
    return F.array(*[F.instr(order, c) for c in letters])


def removal_step(fails: Column, position: Column, n: int) -> Column:
    """Min-plus product of a mask row (``fails``: booleans by filter) and a position column."""
    return F.array_min(F.zip_with(fails, position, lambda f, p: F.when(f, F.lit(0)).otherwise(F.lit(n + 1)) + p))


def audit_filters(classes: DataFrame, letters: str, weights: dict[str, str]) -> DataFrame:
    """Counts by part, filter_order and step (its filter is that letter of the order).

    ``classes``: part, fails (array of booleans, by letter, no nulls), n (long)
    and the columns of ``weights`` (output name -> column, long); rows of one
    part and mask are summed first.  Returns part, filter_order, step, kept,
    removed, redundant, unique_fails, one column a weight (that weight of the
    removed documents) and shapley; every step of every order of every part,
    zeros included.  Other columns of ``classes`` are not read; no rows give
    no rows.
    """
    size = len(letters)
    if size > MOST_FILTERS or len(set(letters)) < size:
        raise ValueError(f"1 to {MOST_FILTERS} different letters, not {letters!r}")
    rows = classes.groupBy("part", "fails").agg(F.sum("n").alias("n"), *[F.sum(c).alias(f"_w{i}") for i, c in enumerate(weights.values())])
    rows = rows.withColumn("filter_order", F.explode(orders_of(letters))).withColumn("position", positions(F.col("filter_order"), letters))
    rows = rows.withColumn("gone", F.least(removal_step(F.col("fails"), F.col("position"), size), F.lit(size + 1)))
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(size))))
    fails_here = F.get("fails", F.array_position("position", F.col("step")).cast("int") - 1)
    failed = F.size(F.filter("fails", lambda f: f))

    def total(condition: Column, what: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(what)).otherwise(F.lit(0))).cast("long")

    here = F.col("gone") == F.col("step")
    out = rows.groupBy("part", "filter_order", "step").agg(
        total(F.col("gone") > F.col("step")).alias("kept"),
        total(here).alias("removed"),
        total(fails_here & (F.col("gone") < F.col("step"))).alias("redundant"),
        total(fails_here & (failed == 1)).alias("unique_fails"),
        *[total(here, f"_w{i}").alias(name) for i, name in enumerate(weights)],
    )
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", letter)))


def text_failures(text: Column) -> Column:
    """Filters A to D as an array of booleans: short, repetitive, capitals, special characters."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")

    def judged(w: Column) -> Column:
        return F.array(F.size(w) < 200, F.size(F.array_distinct(w)) * 100 < F.size(w) * 50)

    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return F.concat(let(words, judged), F.array(capitals * 100 > F.length(text) * 3, text.rlike("[#$%&*|]")))


def document_classes(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Documents by part and failed filters (A to E), with n, good and toxic.

    E: the text equals that of a smaller id.  A null text is empty, a null part
    the empty string.  Rows without id have no smaller or larger ids and no
    labels; of several labels of an id, any 1 counts.  Other columns are not
    read, whatever their names.  Only digests and flags are exchanged, summed
    before each exchange, so any number of copies of a text is a few rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("copy"),
        text_failures(text).alias("own"),
    )
    rows = rows.groupBy("id", "copy", "part", "own").agg(F.count("*").alias("n"))
    # Rows without id spread by their text.
    rows = rows.withColumn("spread", F.when(F.col("id").isNull(), F.xxhash64("copy")).otherwise(F.lit(0)))
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"), F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic")
    )
    rows = rows.join(known.withColumn("spread", F.lit(0).cast("long")), ["id", "spread"], "left")
    groups = rows.groupBy("copy", "part", "own", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")).agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("no_id"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"),
    )
    least = F.min("first.id").over(Window.partitionBy("copy"))
    firsts = F.col("no_id") + F.when(F.col("first.id") == least, F.col("first.n")).otherwise(F.lit(0))
    groups = groups.withColumn("firsts", firsts)
    halves = F.array(F.struct(F.lit(False).alias("copied"), F.col("firsts").alias("docs")), F.struct(F.lit(True).alias("copied"), (F.col("n") - F.col("firsts")).alias("docs")))
    split = groups.select("part", "own", "good", "toxic", F.inline(halves)).filter("docs > 0")
    return split.select("part", F.concat("own", F.array("copied")).alias("fails"), F.col("docs").alias("n"), (F.col("docs") * F.col("good")).alias("good"), (F.col("docs") * F.col("toxic")).alias("toxic"))


def audit_documents(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """The audit of filters A to E over ``docs``; see ``document_classes`` and ``audit_filters``."""
    return audit_filters(document_classes(docs, labels, **columns), "ABCDE", {"good_lost": "good", "toxic_lost": "toxic"})
