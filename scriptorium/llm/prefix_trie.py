"""Prefix trie of rebuilt conversations by composable fingerprints.

A conversation is rebuilt from the head of another one (the first of its
family) and its own turns after that head.  No rebuilt text is made: a turn is
three residues t of its role and text, a sequence of turns the sum of t_j * r^j
modulo a prime, for three primes (93 bits).  These sums form a monoid, as
appending shifts the second part by a power of r; so the fingerprint of every
prefix is the base head's product joined with a difference of the own prefix
products, found with column arithmetic alone.

Rows are (conversation, depth) and small: fingerprints, the last turn's
residues as its reference, and its bytes.  Rows of one depth and fingerprint
are a node.  Equality is verified: residues name one (role, text) each, held
against the stored turns once, and the members of a node share their last
turn's; the same last turn and fingerprint leave the same prefix before it, so
equality follows from depth to depth.  If any group fails, other residues are
drawn and the work starts anew.

A node's owner is its smallest member; the nodes of one owner are the end of
its path.  Every node of a subtree has one owner, a member of the top, so the
sum over a subtree is the sum, over the top's members, of what each owns from
there on: suffix sums along conversations and one aggregate, no walk by level.

No group needs a task of its own: turns are numbered by range partitions, whose
pieces of a conversation (segments) are joined by their products, and nodes of
many conversations are met in ``SALTS`` parts.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import staged

# The largest primes below 2^31: products stay below 2^62.
PRIMES = (2147483647, 2147483629, 2147483587)
POWER_BITS = 40
SALTS, ENDS = 16, 4096
FP = ["f1", "f2", "f3"]
NODE = ["depth", *FP]


class Residues:
    """One draw of residues: a seed of the turn hashes and a base r for each prime."""

    def __init__(self, seed: int):
        rng = random.Random(seed)
        self.seed, self.bases = seed, [rng.randrange(1 << 20, p) for p in PRIMES]

    def turn(self, i: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(3 * self.seed + i), "role", "text"), F.lit(PRIMES[i] - 1)) + 1

    def power(self, i: int, exponent: Column) -> Column:
        """r^exponent by its bits."""
        p, r = PRIMES[i], self.bases[i]

        def times(done: Column, bit: int) -> Column:
            factor = F.when(exponent.bitwiseAND(F.lit(1 << bit)) != 0, F.lit(pow(r, 1 << bit, p))).otherwise(F.lit(1).cast("long"))
            return done * factor % p

        return reduce(times, range(POWER_BITS), F.lit(1).cast("long"))

    def back(self, i: int, steps: Column, most: int) -> Column:
        """r^-steps for 0 to ``most``."""
        p, r = PRIMES[i], self.bases[i]
        return F.get(F.array(*[F.lit(pow(r, -s, p)).cast("long") for s in range(most + 1)]), steps)


def numbered_turns(turns: DataFrame, residues: Residues) -> DataFrame:
    """conv, seg (its range partition), l (place in the segment), t1-t3, nb and the running products s1-s3."""
    keyed = turns.select("conv", "turn", "role", "text", *[residues.turn(i).alias(f"t{i + 1}") for i in range(3)])
    order = ["conv", "turn", "role", "text"]
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = staged(ranged.select("conv", "t1", "t2", "t3", F.octet_length("text").cast("long").alias("nb"), F.monotonically_increasing_id().alias("i")), "trie-turns")
    rows = rows.withColumn("seg", F.shiftright("i", 33).cast("int"))
    inside = Window.partitionBy("conv", "seg").orderBy("i")
    rows = rows.withColumn("l", (F.row_number().over(inside) - 1).cast("long"))
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    sums = [(F.sum(F.col(f"t{i + 1}") * residues.power(i, F.col("l")) % p).over(running) % p).alias(f"s{i + 1}") for i, p in enumerate(PRIMES)]
    return staged(rows.select("conv", "seg", "l", "t1", "t2", "t3", "nb", *sums), "trie-products")


def segments_of(rows: DataFrame, residues: Residues) -> DataFrame:
    """Per segment: turns and product before it (at, b1-b3), and r^at (z1-z3)."""
    segs = rows.groupBy("conv", "seg").agg(F.count("*").alias("n"), F.max_by(F.struct("s1", "s2", "s3"), "l").alias("s"))
    before = Window.partitionBy("conv").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    segs = segs.withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0)))
    segs = segs.select("*", *[residues.power(i, F.col("at")).alias(f"z{i + 1}") for i in range(3)])
    products = [(F.coalesce(F.sum(F.col(f"s.s{i + 1}") * F.col(f"z{i + 1}") % p).over(before), F.lit(0)) % p).alias(f"b{i + 1}") for i, p in enumerate(PRIMES)]
    return segs.select("conv", "seg", "n", "at", "z1", "z2", "z3", *products)


def _prefix(i: int) -> Column:
    """Product of a conversation's turns up to this row, from its segment's."""
    k = i + 1
    return (F.col(f"b{k}") + F.col(f"s{k}") * F.col(f"z{k}") % PRIMES[i]) % PRIMES[i]


def rebuilt(rows: DataFrame, residues: Residues, family: int, heads: int) -> DataFrame:
    """Rows of all rebuilt prefixes, the empty one too: conv, seg (-1: head), depth, f1-f3, t1-t3, nb, last."""
    segs = staged(segments_of(rows, residues), "trie-segments")
    most = heads - 1
    early = rows.filter(F.col("l") < most).join(segs.filter(F.col("at") < most), ["conv", "seg"]).withColumn("pos", F.col("at") + F.col("l")).filter(F.col("pos") < most)
    head = F.struct("pos", *[_prefix(i).alias(f"f{i + 1}") for i in range(3)], "t1", "t2", "t3", "nb")
    head = early.groupBy("conv").agg(F.sort_array(F.collect_list(head)).alias("head"))
    own = segs.groupBy("conv").agg(F.sum("n").alias("n")).join(head, "conv", "left")
    own = own.withColumn("h", F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(heads)).cast("int"))
    base = own.select(F.col("conv").alias("base"), F.col("head").alias("base_head"))
    info = own.withColumn("base", F.col("conv") - F.pmod("conv", F.lit(family))).join(base, "base", "left")
    k = F.least("h", F.coalesce(F.size("base_head"), F.lit(0)))
    info = info.withColumn("k", F.when(F.col("base_head").isNull(), 0).otherwise(k))
    info = info.withColumn("length", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    m = F.least(F.col("h").cast("long"), F.col("n")).cast("int")
    joined = [F.when(F.col("k") > 0, F.get("base_head", F.col("k") - 1)[f"f{i + 1}"]).otherwise(0).alias(f"p{i + 1}") for i in range(3)]
    cut = [F.when(m > 0, F.get("head", m - 1)[f"f{i + 1}"]).otherwise(0).alias(f"c{i + 1}") for i in range(3)]
    shift = [residues.back(i, F.col("h") - F.col("k"), most).alias(f"y{i + 1}") for i in range(3)]
    info = staged(info.select("conv", "h", "k", "length", *joined, *cut, *shift, F.when(F.col("k") > 0, F.slice("base_head", 1, F.col("k"))).alias("taken")), "trie-heads")

    zero = F.lit(0).cast("long")
    root = F.array(F.struct(zero.alias("depth"), *[zero.alias(c) for c in [*FP, "t1", "t2", "t3", "nb"]]))
    taken = F.transform("taken", lambda x: F.struct((x["pos"] + 1).alias("depth"), *[x[c].alias(c) for c in [*FP, "t1", "t2", "t3", "nb"]]))
    first = info.select("conv", F.lit(-1).alias("seg"), "length", F.inline(F.when(F.col("taken").isNull(), root).otherwise(F.concat(root, taken))))
    rest = rows.join(segs.drop("n").join(info.drop("taken"), "conv"), ["conv", "seg"]).filter(F.col("at") + F.col("l") >= F.col("h"))
    depth = (F.col("at") + F.col("l") - F.col("h") + F.col("k") + 1).alias("depth")
    prints = [((F.col(f"p{i + 1}") + (_prefix(i) - F.col(f"c{i + 1}") + p) % p * F.col(f"y{i + 1}")) % p).alias(f"f{i + 1}") for i, p in enumerate(PRIMES)]
    rest = rest.select("conv", "seg", "length", depth, *prints, "t1", "t2", "t3", "nb")
    return first.unionByName(rest).withColumn("last", F.col("depth") == F.col("length")).drop("length")


def meet(rows: DataFrame) -> DataFrame:
    """Per node and salt: owner, n_convs, n_ends of the whole node, and whether its members' last turns agree."""
    parts = rows.groupBy(*NODE, F.pmod("conv", F.lit(SALTS)).cast("int").alias("salt")).agg(
        F.min("conv").alias("owner"), F.count("*").alias("n"), F.count_if("last").alias("ends"),
        *[f(f"t{i}").alias(f"{f.__name__}{i}") for i in (1, 2, 3) for f in (F.min, F.max)],
    )
    node = Window.partitionBy(*NODE)
    agrees = reduce(lambda a, b: a & b, [F.min(f"min{i}").over(node) == F.max(f"max{i}").over(node) for i in (1, 2, 3)])
    return parts.select(*NODE, "salt", F.min("owner").over(node).alias("owner"), F.sum("n").over(node).alias("n_convs"), F.sum("ends").over(node).alias("n_ends"), agrees.alias("agrees"))


def hash_ends(rows: DataFrame) -> DataFrame:
    """SHA-256 of each node's ending conversations, in order.

    Ids are written out in pieces by number range; one running hash a node
    reads the pieces in order, whatever their number.
    """
    ends = rows.filter("last").groupBy(*NODE, F.floor(F.col("conv") / ENDS).alias("piece")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 4 + [pa.string()]
        node, digest = None, None
        for batch in batches:
            out = []
            for *key, ids in zip(*[batch.column(c).to_pylist() for c in [*NODE, "ids"]], strict=True):
                if key == node:
                    digest.update(b"," + ids.encode())
                    continue
                if node is not None:
                    out.append((*node, digest.hexdigest()))
                node, digest = key, hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[*NODE, "sha"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((*node, digest.hexdigest()), types, strict=True)], names=[*NODE, "sha"])

    ordered = ends.repartition(*NODE).sortWithinPartitions(*NODE, "piece")
    return ordered.mapInArrow(run, ", ".join(f"{c} long" for c in NODE) + ", sha string")


def subtree_sums(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes with all counts: each row adds what its conversation owns from its depth on."""
    salted = rows.withColumn("salt", F.pmod("conv", F.lit(SALTS)).cast("int"))
    known = salted.join(nodes.drop("agrees"), [*NODE, "salt"])
    owned = F.col("owner") == F.col("conv")
    known = known.withColumn("saved", F.when(owned, (F.col("n_convs") - 1) * F.col("nb")).otherwise(0)).withColumn("leaf", F.when(owned & (F.col("n_ends") == F.col("n_convs")), 1).otherwise(0))
    path = Window.partitionBy("conv", "seg").orderBy("depth")
    rest = path.rowsBetween(0, Window.unboundedFollowing)
    known = known.select(
        "conv", "seg", *NODE, "owner", "n_convs", "saved", "leaf",
        F.sum("saved").over(rest).alias("saved_on"), F.sum("leaf").over(rest).alias("leaves_on"),
        F.lead(owned.cast("int")).over(path).alias("next_owned"), F.lag("owner").over(path).alias("parent"),
    )
    known = staged(known, "trie-paths")
    segs = known.groupBy("conv", "seg").agg(
        F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"), F.min_by((owned).cast("int"), "depth").alias("first_owned"), F.max_by("owner", "depth").alias("last_owner")
    )
    path = Window.partitionBy("conv").orderBy("seg")
    later = path.rowsBetween(1, Window.unboundedFollowing)
    segs = segs.select(
        "conv", "seg", F.coalesce(F.sum("saved").over(later), F.lit(0)).alias("saved_after"), F.coalesce(F.sum("leaf").over(later), F.lit(0)).alias("leaves_after"),
        F.lead("first_owned").over(path).alias("owned_after"), F.lag("last_owner").over(path).alias("owner_before"),
    )
    joined = known.drop("saved", "leaf").join(segs, ["conv", "seg"])
    return joined.groupBy(*NODE).agg(
        F.min("conv").alias("conv_id"),
        F.max(F.when(owned, F.coalesce("parent", "owner_before"))).alias("parent_conv_id"),
        F.count("*").alias("n_convs"),
        F.sum(F.coalesce("next_owned", "owned_after", F.lit(0))).cast("long").alias("n_children"),
        F.sum(F.col("leaves_on") + F.col("leaves_after")).cast("long").alias("n_leaves"),
        F.sum(F.col("saved_on") + F.col("saved_after")).cast("long").alias("saved_tokens"),
    )


def prefix_trie(turns: DataFrame, family: int = 5, heads: int = 9, seeds: Iterator[int] = range(100)) -> DataFrame:
    """Nodes of the trie of rebuilt conversations of ``turns`` (conv_id, turn, role, text).

    Conversation c takes the first h = crc32(c) % heads turns of conversation
    c - c % family (the remainder is not negative), then its own turns after
    its first h.  Turns are in order of turn, null first; ties by role and
    text, repeated rows stay turns of their own.  A null role or text is empty;
    rows without conv_id belong to no conversation.  Other columns are not
    read, whatever their names.  No rows give no nodes, not even a root.

    Returns conv_id (smallest member), depth, parent_conv_id (null for the
    root), n_convs, n_children, n_leaves, saved_tokens and ends_sha256.
    """
    turns = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    for seed in seeds:
        residues = Residues(seed)
        names = [residues.turn(i).alias(f"t{i + 1}") for i in range(3)]
        if turns.select(*names, "role", "text").distinct().groupBy("t1", "t2", "t3").count().filter("count > 1").head(1):
            continue
        rows = staged(rebuilt(numbered_turns(turns, residues), residues, family, heads), "trie-prefixes")
        nodes = staged(meet(rows), "trie-nodes")
        if nodes.filter("not agrees").head(1):
            continue
        out = subtree_sums(rows, nodes).join(hash_ends(rows), NODE, "left")
        none = F.lit(hashlib.sha256(b"").hexdigest())
        return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", none).alias("ends_sha256"))
    raise RuntimeError("every draw of residues met a collision")
