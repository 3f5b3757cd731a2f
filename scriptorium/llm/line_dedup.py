"""Line dedup by an exact set-similarity join, as built-in functions only.

A line is the set of its five-word shingles (of fewer words: the whole line),
each a 64-bit hash.  Two lines match when 100 * intersection >= 75 * union of
their sets.  Prefix filter: with the tokens of a line ordered by rarity, two
matching lines share a token among the first n - ceil(0.75 n) + 1 of each.
Positional and length filters drop pairs whose places and sizes rule a match
out; the rest is verified on the full sets.  A line goes if an earlier line (by
document id, then line number) matches.

Equal lines meet first, so any number of copies is one entry of the join.  The
question is only whether some earlier line matches, so the join goes in two
rounds: each line meets one of its lists' first lines, and only lines left open
meet all the others.  A group of near copies then costs about a pair a line.  A
token's rarity is its count in the corpus by hash slot (2^16 slots); any order
that all lines share gives the exact result, and this one keeps the tokens that
many lines share out of the prefixes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.arrays import let
from scriptorium.llm.common import discard, staged

WORDS, SLOT_BITS, CLASS_BITS = 5, 16, 9
SPACE = r"[\x20\x09-\x0D]+"
# A line of a document: its number above 40 bits of its hash.
LINE_BITS, MOST_LINES = 40, (1 << 23) - 1
PLACED, ENDS = ("id", "ref", "place"), ["a_id", "a_ref", "b_id", "b_ref"]


def shingles(line: Column) -> Column:
    """Shingle hashes of a line in order, repeats included; a line has words."""

    def rolled(h: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(h) - WORDS)
        each = F.transform(places, lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(WORDS)]))
        return F.when(F.size(h) < WORDS, F.array(F.xxhash64(h))).otherwise(each)

    return let(F.transform(line_words(line), lambda w: F.xxhash64(w)), rolled)


def line_words(line: Column) -> Column:
    """Words of a line that has some; single blanks between them need no regular expression."""
    odd = F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    for blank in ("  ", *"\t\n\x0b\f\r"):
        odd = odd | F.contains(line, F.lit(blank))
    return F.when(odd, F.split(F.btrim(line, F.lit(" \t\n\x0b\f\r")), SPACE)).otherwise(F.split(line, " "))


def line_ref(at: Column, line: Column) -> Column:
    number = F.least(at, F.lit(MOST_LINES)).cast("long")
    return F.shiftleft(number, LINE_BITS).bitwiseOR(F.shiftrightunsigned(F.xxhash64(line), 64 - LINE_BITS))


def text_lines(text: Column) -> Column:
    return F.split(text, "\n")


def _slot(token: Column) -> Column:
    return token.bitwiseAND(F.lit((1 << SLOT_BITS) - 1)).cast("int")


def slot_classes(lines: DataFrame) -> Column:
    """A constant array: how frequent the shingles of each hash slot are, in eighths of an octave."""
    tokens = lines.select(F.explode(shingles(F.col("line"))).alias("token"))
    counts = tokens.groupBy(_slot(F.col("token")).alias("slot")).agg(F.count("*").alias("n")).collect()
    classes = [0] * (1 << SLOT_BITS)
    for r in counts:
        classes[r["slot"]] = int(8 * math.log2(1 + r["n"]))
    return F.split(F.lit(",".join(map(str, classes))), ",").cast("array<int>")


def _needed(a: Column, b: Column, percent: int) -> Column:
    """100 * o >= percent * (a + b - o) for an intersection of o."""
    return F.ceil((a + b) * percent / (100 + percent))


def has_words(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def line_marks(docs: DataFrame, percent: int) -> DataFrame:
    """By k (document; ``docs``: id, text): refs of the lines that are the first of their equals, and of those near an earlier line."""
    lines = docs.select("id", F.posexplode(text_lines(F.col("text"))).alias("at", "line")).filter(has_words(F.col("line")))
    lines = lines.select("id", "line", line_ref(F.col("at"), F.col("line")).alias("ref"), F.unhex(F.md5(F.col("line").cast("binary"))).alias("key"))
    classes = slot_classes(lines)

    def by_rarity(token: Column) -> Column:
        return F.shiftleft(F.get(classes, _slot(token)).cast("long"), 63 - CLASS_BITS).bitwiseOR(F.shiftrightunsigned(token, CLASS_BITS + 1))

    # Only what works by element stands in lambdas; taking out repeats, sorting and cutting is compiled.
    n = F.size("tokens")
    sets = lines.select("key", "id", "ref", F.array_distinct(shingles(F.col("line"))).alias("tokens"))
    sets = sets.select("key", "id", "ref", n.alias("n"), F.sort_array(F.transform("tokens", by_rarity)).alias("ordered"))
    prefix = F.slice("ordered", 1, F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1)
    sets = sets.select("key", "id", "ref", F.struct("n", prefix.alias("prefix")).alias("s"))
    first = F.min(F.struct("id", "ref", "s"))
    firsts = staged(sets.groupBy("key").agg(first.alias("first")).select("key", "first.id", "first.ref", "first.s.n", "first.s.prefix"), "line-firsts")

    posts = firsts.select("id", "ref", "n", F.posexplode("prefix").alias("at", "token"))
    posts = posts.select("token", "id", "ref", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("at").cast("long")).alias("place"))
    # Most tokens are one line's: only lists of two lines or more are kept.
    lists = staged(posts.groupBy("token").agg(F.count("*").alias("lines")).filter("lines > 1").select("token"), "line-lists")
    posts = staged(posts.join(lists, "token"), "line-posts")
    marks = staged(firsts.select(_key("id").alias("k"), "ref", F.lit(None).cast("long").alias("near")), "line-marks")
    discard(firsts, lists)

    # The full sets of all lines in lists serve both rounds.
    wanted = posts.select("id", "ref").distinct().groupBy(_key("id").alias("k")).agg(F.collect_set("ref").alias("refs"))
    asked = docs.select(_key("id").alias("k"), "text").join(wanted, "k").select("k", "refs", F.posexplode(text_lines(F.col("text"))).alias("at", "line"))
    asked = asked.withColumn("ref", line_ref(F.col("at"), F.col("line"))).filter(F.array_contains("refs", F.col("ref")))
    full = staged(asked.select("k", "ref", F.array_distinct(shingles(F.col("line"))).alias("tokens")).dropDuplicates(["k", "ref"]), "line-sets")

    # First round: a line meets one earlier line, of its lists' first lines the one in most of them.
    heads = posts.groupBy("token").agg(F.min(F.struct(*PLACED)).alias("h")).select("token", *[F.col(f"h.{c}").alias(f"a_{c}") for c in PLACED])
    shared = _side(posts, "b").join(heads, "token").filter(_reach(percent))
    shared = shared.groupBy(*ENDS).agg(F.count("*").alias("lists"))
    best = shared.groupBy("b_id", "b_ref").agg(F.max(F.struct("lists", "a_id", "a_ref")).alias("a"))
    near = staged(_verified(best.select("a.a_id", "a.a_ref", "b_id", "b_ref"), full, percent), "line-near")
    # Second round: the lines still open meet all earlier lines of their lists.
    still = posts.join(near, [F.col("id").eqNullSafe(F.col("b_id")), F.col("ref") == F.col("b_ref")], "left_anti")
    pairs = _side(posts, "a").join(_side(still, "b"), "token").filter(_reach(percent)).select(*ENDS).distinct()
    more = staged(_verified(pairs, full, percent), "line-near")
    discard(posts, full)
    marks = marks.union(near.union(more).select(_key("b_id").alias("k"), F.lit(None).cast("long"), F.col("b_ref")))
    return marks.groupBy("k").agg(F.collect_set("ref").alias("firsts"), F.collect_set("near").alias("near"))


def _side(posts: DataFrame, x: str) -> DataFrame:
    return posts.select("token", *[F.col(c).alias(f"{x}_{c}") for c in PLACED])


def _reach(percent: int) -> Column:
    """Line a is earlier than b, and sizes and places leave room for a match."""
    n, at = (lambda c: F.shiftright(c, 32)), (lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)))
    n_a, n_b = n("a_place"), n("b_place")
    return (
        # Null ids are one document before all others.
        (F.struct("a_id", "a_ref") < F.struct("b_id", "b_ref"))
        & (F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent)
        & (F.least(n_a - at("a_place"), n_b - at("b_place")) >= _needed(n_a, n_b, percent))
    )


def _verified(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """b_id and b_ref of every line b of ``pairs`` whose full set matches a's."""
    left = full.select(F.col("k").alias("a_k"), F.col("ref").alias("a_ref"), F.col("tokens").alias("a_tokens"))
    right = full.select(F.col("k").alias("b_k"), F.col("ref").alias("b_ref"), F.col("tokens").alias("b_tokens"))
    # Joined by keys without nulls.
    both = pairs.select(_key("a_id").alias("a_k"), "a_ref", "b_id", _key("b_id").alias("b_k"), "b_ref").join(left, ["a_k", "a_ref"])
    both = both.select("a_tokens", "b_id", "b_k", "b_ref").join(right, ["b_k", "b_ref"])
    shared = F.size(F.array_intersect("a_tokens", "b_tokens"))
    return both.filter(shared >= _needed(F.size("a_tokens"), F.size("b_tokens"), percent)).select("b_id", "b_ref").distinct()


def _key(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def dedup_lines(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", removed_col: str = "removed_lines") -> DataFrame:
    """Every row of ``docs`` with its text less the lines that an earlier line matches.

    All columns stay, of any names; ``removed_col`` (number of removed lines) is
    added, replacing a column of that name.  Lines without words stay, so does
    a row whose lines all go (its text is what is left, maybe empty).  A null
    text stays null.  Null ids count as one document before all others; rows
    that repeat an id are one document's, and equal lines at one place of it
    count once.  An empty table gives an empty result.
    """
    marks = line_marks(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), percent)
    base = docs.select(_key(id_col).alias("k"), F.struct("*").alias("row"))
    # Read through ``let``, a row stays whole in its exchange.
    text = let(F.col("row"), lambda r: r[text_col])
    # A document all of whose lines are copies has no marks.
    none = F.array().cast("array<bigint>")
    rows = base.join(marks.hint("shuffle_hash"), "k", "left").select("row", text.alias("text"), F.coalesce("firsts", none).alias("firsts"), F.coalesce("near", none).alias("near"))

    def left(lines: Column) -> Column:
        refs = F.transform(lines, lambda line, i: F.when(has_words(line), line_ref(i, line)))
        gone = F.array_compact(F.concat(F.array_except(refs, "firsts"), "near"))
        return let(gone, lambda out: F.struct(F.filter(lines, lambda line, i: ~F.array_contains(out, line_ref(i, line))).alias("lines"), F.size(lines).alias("n")))

    rows = rows.select("row", "text", F.when(F.col("text").isNotNull(), let(text_lines(F.col("text")), left)).alias("left"))
    new_text = F.when(F.col("left").isNull(), F.col("text")).otherwise(F.array_join("left.lines", "\n"))
    removed = F.coalesce((F.col("left.n") - F.size("left.lines")).cast("long"), F.lit(0).cast("long"))
    return rows.select(F.col("row").withField(text_col, new_text).withField(removed_col, removed).alias("row")).select("row.*")
