"""Exact Jaccard join on five-word shingles with skipping by set relations.

A document's set has its distinct five-word shingles (64-bit hashes; fewer
words: the whole sequence; none: empty).  Equal sets meet first and go on as
one node, known by a hash of one of its rows (id and text); ids come back at the
end.  Tokens are ordered by rarity (their count by hash slot of 2^22, then hash),
fine enough to put the tokens of a passage that ten documents share behind those
of one document at 20 tokens a slot; any order gives the same links.  A
set of n posts its first n - ceil(0.75 n) + 1 tokens with their positions, so
that two linked sets meet in at least one list.

Lists are ordered by set size, then position.  Index-level skipping: scanning
from a set ends at the first set too large for it, and sets whose remaining
tokens after their position cannot reach the overlap are passed over.
Answer-level skipping, for lists of more than ``HOT`` sets: first only the
list's most central set is compared with the others; a set found in the same
component takes over the component's answers, so only sets outside of it are
then compared, with the sets of other components.  Every comparison left is
verified on the full sets, hence no link between components is lost.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import BROADCAST_IDS, discard, staged
from scriptorium.llm.graph import components

WORDS, SLOT_BITS, HOT = 5, 22, 64
# Slot counts travel in chunks of so many slots; a slot becomes a class of a sixteenth of an octave.
SLOTS, CLASSES = 1 << 13, 16
KEPT_WORDS, PROFILE = 200_000, 192
# A worker holds the sets of so many bytes of text at one time.
PART_BYTES = 2_000_000
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser (fixed values above)."""
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Word hashes are kept, up to a bound, for the tasks of a Python worker."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct shingle hashes."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        known = self.known
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        size = min(WORDS, len(h))
        out = np.full(len(h) - size + 1, size, np.uint64)
        for j in range(size):
            out = _mixed((out + MIX[0]) ^ h[j : len(h) - size + 1 + j])
        out.sort()
        return out[np.append(True, out[1:] != out[:-1])]


@lru_cache(maxsize=1)
def shingler() -> Shingler:
    return Shingler()


def _slots(tokens: np.ndarray) -> np.ndarray:
    return (tokens & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, cut after every PART_BYTES of text."""
    for batch in batches:
        size = pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = (np.flatnonzero(np.diff(np.cumsum(size) // PART_BYTES)) + 1).tolist()
        for a, b in zip([0, *cuts], [*cuts, len(size)], strict=True):
            if b > a:
                yield batch.slice(a, b - a)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and signature of every set; at the end the task's token counts by slot, in compressed chunks."""
    counts = np.zeros(1 << SLOT_BITS, np.uint32)
    names = ["id", "row", "n", "signature", "chunk", "counts"]
    for batch in _parts(batches):
        sets = [shingler()(t) for t in batch.column("text").to_pylist()]
        for s in sets:
            np.add.at(counts, _slots(s), np.uint32(1))
        rows = len(sets)
        signatures = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row"), pa.array([len(s) for s in sets], pa.int64()), pa.array(signatures, pa.binary()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names)
    chunks = counts.reshape(-1, SLOTS)
    at = np.flatnonzero(chunks.any(1))
    packed = [zlib.compress(chunks[i].tobytes(), 1) for i in at]
    yield pa.RecordBatch.from_arrays([*[pa.nulls(len(at), pa.int64())] * 3, pa.nulls(len(at), pa.binary()), pa.array(at, pa.int32()), pa.array(packed, pa.binary())], names)


def _slot_classes(group: pa.Table) -> pa.Table:
    """Frequency classes of a chunk's slots from the counts of all tasks."""
    total = np.zeros(SLOTS)
    for packed in group.column("counts").to_pylist():
        total += np.frombuffer(zlib.decompress(packed), np.uint32)
    classes = (CLASSES * np.log2(1 + total)).astype("<u2")
    return pa.table({"chunk": group.column("chunk")[:1], "classes": pa.array([classes.tobytes()], pa.binary())})


def _rarity(classes: bytes, tokens: np.ndarray) -> np.ndarray:
    """Frequency class above the hash's upper bits, as signed numbers; distinct up to 53 bits."""
    rank = np.frombuffer(classes, "<u2")[_slots(tokens)].astype(np.uint64)
    return (rank << np.uint64(53) | tokens >> np.uint64(11)).astype(np.int64)


def _need(a: Column, b: Column, percent: int) -> Column:
    return F.ceil((a + b) * percent / (100 + percent))


def _small_lists(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of the sets in lists of at most HOT; rows come by token, n, at."""
    rest = None

    def pairs(token, n, at, ids):
        live = np.arange(len(token))
        for d in range(1, HOT):
            live = live[live + d < len(token)]
            there = live + d
            # The list or the sizes within reach end here for the others.
            live = live[(token[live] == token[there]) & (n[live] * 100 >= n[there] * percent)]
            if not len(live):
                return
            there = live + d
            need = -(-(n[live] + n[there]) * percent // (100 + percent))
            ok = np.minimum(n[live] - at[live], n[there] - at[there]) >= need
            a, b = ids[live[ok]], ids[there[ok]]
            yield np.minimum(a, b), np.maximum(a, b)

    def found(columns):
        got = list(pairs(*columns))
        if got:
            both = np.unique(np.stack([np.concatenate(x) for x in zip(*got, strict=True)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    for batch in batches:
        columns = [batch.column(c).to_numpy() for c in ("token", "n", "at", "id")]
        if rest is not None:
            columns = [np.concatenate(x) for x in zip(rest, columns, strict=True)]
        if len(columns[0]):
            cut = np.searchsorted(columns[0], columns[0][-1])  # the last list may go on
            yield from found([c[:cut] for c in columns])
            rest = [c[cut:] for c in columns]
    if rest is not None:
        yield from found(rest)


def _verified(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    asked = staged(pairs.select(F.col("a").alias("asked")).union(pairs.select("b")).distinct(), "join-asked")
    few = asked.count() <= BROADCAST_IDS
    texts = docs.join(F.broadcast(asked) if few else asked, docs["id"] == asked["asked"]).select("id", "text")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            sets = [shingler()(t).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.binary())], ["id", "tokens"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("a_tokens"), batch.column("b_tokens"), strict=True):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sets = staged(texts.mapInArrow(full, "id long, tokens binary"), "join-sets")
    a, b = (sets.select(F.col("id").alias(f"{s}_id"), F.col("tokens").alias(f"{s}_tokens")) for s in "ab")
    both = pairs.join(a, F.col("a") == F.col("a_id")).join(b, F.col("b") == F.col("b_id"))
    links = staged(both.select("a", "b", "a_tokens", "b_tokens").mapInArrow(check, "a long, b long"), "join-links")
    discard(sets, asked)
    return links


def _profile(tokens: np.ndarray) -> bytes:
    """How many tokens fall into each of PROFILE hash classes."""
    return np.bincount((tokens >> np.uint64(40)).astype(np.int64) % PROFILE, minlength=PROFILE).clip(max=65_535).astype("<u2").tobytes()


def _possible(pairs: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """The pairs whose profiles leave room for enough shared tokens: by class, no more than the smaller count."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, PROFILE).astype(np.int64) for c in ("a_profile", "b_profile"))
            full = (np.maximum(x, y) == 65_535).any(1)
            n_a, n_b = (batch.column(c).to_numpy() for c in ("a_n", "b_n"))
            room = np.minimum(x, y).sum(1)
            yield batch.select(["a", "b"]).filter(pa.array(full | (100 * room >= percent * (n_a + n_b - room))))

    a, b = (profiles.select(F.col("id").alias(f"{s}_id"), F.col("n").alias(f"{s}_n"), F.col("profile").alias(f"{s}_profile")) for s in "ab")
    both = pairs.join(a, F.col("a") == F.col("a_id")).join(b, F.col("b") == F.col("b_id"))
    return both.select("a", "b", "a_n", "b_n", "a_profile", "b_profile").mapInArrow(check, "a long, b long")


def jaccard_components(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (smallest id reachable by links) of every row.

    Ids are integers.  Null and empty texts have empty sets and link with
    nothing.  Every row takes part with its own set.  Rows that repeat an id are
    linked by it, as links are between ids; null ids link nothing, each such row
    counts as the smallest integer, and a component with one is null.  An empty
    table gives an empty result.  Other columns are not read.
    """
    least = -(1 << 63)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(least)).alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("row", F.xxhash64("id", "text"))
    seen = staged(rows.mapInArrow(_count, "id long, row long, n long, signature binary, chunk int, counts binary"), "join-seen")
    table = np.zeros(1 << SLOT_BITS, "<u2")
    parts = seen.filter("chunk IS NOT NULL").select("chunk", "counts").groupBy("chunk").applyInArrow(_slot_classes, "chunk int, classes binary")
    for r in parts.collect():  # the table's fixed size: 8 MB
        table[r["chunk"] * SLOTS : (r["chunk"] + 1) * SLOTS] = np.frombuffer(r["classes"], "<u2")
    classes = table.tobytes()
    members = seen.filter("chunk IS NULL").select("id", "row", "n", "signature")
    first_row = F.min(F.struct("id", "row")).alias("rep")
    reps = members.filter("n > 0").groupBy("signature").agg(first_row, F.count("*").alias("rows"))
    reps = staged(reps.select("signature", F.col("rep.id").alias("rep"), F.col("rep.row").alias("node"), "rows"), "join-reps")

    # Of equal sets only the representative row posts, once if it is repeated with id and text.
    equal = members.join(reps.filter("rows > 1").select("signature", "node"), "signature").groupBy("row").agg(F.first("node").alias("node"), F.count("*").alias("times"))
    equal = staged(equal.select("row", (F.col("row") == F.col("node")).alias("first"), "times").filter("NOT first OR times > 1"), "join-copies")
    copies = equal.select(F.col("row").alias("copy"))
    few = copies.count() <= BROADCAST_IDS
    texts = rows.select(F.col("row").alias("id"), "text")
    single = texts.join(F.broadcast(copies) if few else copies, texts["id"] == copies["copy"], "left_anti")
    again = equal.filter("first").select(F.col("row").alias("copy"))
    if again.head(1):
        single = single.union(texts.join(again, texts["id"] == again["copy"], "left_semi").dropDuplicates(["id"]))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            sets = [shingler()(t) for t in batch.column("text").to_pylist()]
            sizes = [len(s) for s in sets]
            heads = [np.sort(_rarity(classes, s))[: n + (-n * percent // 100) + 1] if n else [] for s, n in zip(sets, sizes, strict=True)]
            profiles = [_profile(s) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(profiles, pa.binary()), pa.array(heads, pa.list_(pa.int64()))], ["id", "n", "profile", "prefix"])

    # The profile goes with the first posting of a set.
    heads = single.mapInArrow(post, "id long, n long, profile binary, prefix array<long>").filter("n > 0")
    posts = heads.select("id", "n", "profile", F.posexplode("prefix").alias("at", "token"))
    size = F.count("*").over(Window.partitionBy("token"))
    posts = posts.select("token", "id", "n", F.col("at").cast("long").alias("at"), F.when(F.col("at") == 0, F.col("profile")).alias("profile"))
    posts = staged(posts.withColumn("sets", size).filter("sets > 1 OR at = 0"), "join-posts")
    profiles = posts.filter("at = 0").select("id", "n", "profile")
    posts = posts.filter("sets > 1").select("token", "id", "n", "at", "sets")

    small = posts.filter(F.col("sets") <= HOT).repartition("token").sortWithinPartitions("token", "n", "at", "id")
    near = small.select("token", "n", "at", "id").mapInArrow(lambda batches: _small_lists(batches, percent), "a long, b long")

    hot = posts.filter(F.col("sets") > HOT).select("token", "id", "n", "at")

    def reach(x: str, y: str) -> Column:
        n_x, n_y = F.col(f"{x}_n"), F.col(f"{y}_n")
        left = F.least(n_x - F.col(f"{x}_at"), n_y - F.col(f"{y}_at"))
        return (F.least(n_x, n_y) * 100 >= F.greatest(n_x, n_y) * percent) & (left >= _need(n_x, n_y, percent))

    def side(df: DataFrame, x: str) -> DataFrame:
        return df.select("token", *[F.col(c).alias(f"{x}_{c}") for c in df.columns if c != "token"])

    def ordered(df: DataFrame) -> DataFrame:
        return df.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).filter("a < b").distinct()

    centre = hot.groupBy("token").agg(F.min(F.struct("at", "n", "id")).alias("c")).select("token", F.col("c.id").alias("x_id"), F.col("c.n").alias("x_n"), F.col("c.at").alias("x_at"))
    stars = ordered(centre.join(side(hot, "y"), "token").filter(reach("x", "y")))
    first = staged(near.union(stars).distinct(), "join-pairs")
    links = _verified(staged(_possible(first, profiles, percent), "join-possible"), single, percent)

    labels = components(links)
    of = hot.join(labels, "id", "left").select("token", "id", "n", "at", F.coalesce("component", "id").alias("component"))
    of = staged(of, "join-hot")
    largest = of.groupBy("token", "component").agg(F.count("*").alias("sets")).groupBy("token").agg(F.max(F.struct("sets", "component")).alias("m")).select("token", F.col("m.component").alias("main"))
    outside = of.join(largest, "token").filter("component <> main").select("token", "id", "n", "at", "component")
    again = ordered(side(outside, "x").join(side(of, "y"), "token").filter(reach("x", "y") & (F.col("x_component") != F.col("y_component"))))
    again = staged(again.join(first, ["a", "b"], "left_anti"), "join-pairs")
    if again.head(1):
        more = _verified(staged(_possible(again, profiles, percent), "join-possible"), single, percent)
        links = links.union(more)
        labels = components(links)

    # Sets of one id are linked by it.
    repeated = staged(members.filter(F.col("id") != least).groupBy("id").agg(F.count("*").alias("rows")).filter("rows > 1").select("id"), "join-repeated")
    any_repeated = bool(repeated.head(1))
    if any_repeated:
        of_id = members.join(repeated, "id").join(reps.select("signature", "node"), "signature").select("id", "node")
        star = staged(of_id.join(of_id.groupBy("id").agg(F.min("node").alias("a")), "id").filter("a <> node").select("a", F.col("node").alias("b")).distinct(), "join-same-id")
        labels = components(links.union(star))

    linked = staged(reps.join(labels, F.col("node") == F.col("id")).select("signature", "rep", "component"), "join-linked")
    lowest = linked.groupBy("component").agg(F.min("rep").alias("least"))
    linked = linked.join(lowest, "component").select(F.col("signature").alias("linked"), "least")
    classes_of = reps.join(linked, F.col("signature") == F.col("linked"), "left").select("signature", F.coalesce("least", "rep").alias("component"))
    nodes = members.join(classes_of, "signature", "left").select("id", "n", F.coalesce("component", "id").alias("component"))
    if any_repeated:
        # Empty sets of such an id go with its others.
        nodes = staged(nodes, "join-nodes")
        whole = nodes.join(repeated, "id").groupBy("id").agg(F.min("component").alias("least"))
        nodes = nodes.join(whole, "id", "left").select("id", "n", F.coalesce("least", "component").alias("component"))
    out = lambda c: F.when(F.col(c) != least, F.col(c))
    return nodes.select(out("id").alias("doc_id"), F.col("n").alias("n_shingles"), out("component").alias("component_id"))
