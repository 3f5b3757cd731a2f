"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A token (a lower-cased word, or the end of the text) is a code of 18 bits, three
symbols of six: its leaf, from hashes of its first and last letters, and the two
halves of the hash of the whole word.  Every bit of all three is predicted by
several contexts (none, the leaf before, the two leaves before, the hashed word
before, each together with the symbols of the token that are known already, and
what the text itself has shown lately), whose predictions are mixed in the
logistic domain.  Each bit depth of each symbol has its own set of weights; they
start from the mean of what all training texts end with and are refined after
every bit through the whole text.  Words that share all 18 bits are told apart
by their shares of the corpus count, an unknown one by the share of tokens seen
once.  Unknown tokens are one event, as in the unigram base score.

Corpus counts cover every training document: they come by blocks of documents,
so that a block's words meet their counts in one dictionary instead of word by
word.  The context tables have a fixed size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import staged

BITS, HASH_BITS = 6, 12
LEAVES = 1 << BITS
# Slots of the contexts: none, leaf before, two leaves before, hashed word before.
TABLES = (1, LEAVES, LEAVES * LEAVES, 1 << HASH_BITS)
STARTS = np.cumsum([0, *(t * LEAVES for t in TABLES)])
# The symbols of a token after its leaf: their contexts are hashed together with the symbols before.
SYMBOLS = 3
HASHED = (1 << HASH_BITS,) * len(TABLES)
HASHED_STARTS = np.cumsum([0, *(t * LEAVES for t in HASHED)])
SIZES = [STARTS[-1], *[HASHED_STARTS[-1]] * (SYMBOLS - 1)]
CHUNK = 1 << 13
KINDS = 1 << BITS + HASH_BITS
INPUTS = len(TABLES) + 1
# A leaf with a one before it, shifted by these, gives the nodes of its path.
SHIFTS = BITS - np.arange(BITS)[:, None]
FIRST_WEIGHT, RATE, RECENT = 0.3, 0.02, 0.06
# Bytes of text whose words are told apart at one time.
RUN_BYTES = 32_000_000
BLOCK_CHARS = 12_000_000
# Texts mixed side by side, tokens whose contexts are looked up at one time (both within a core's cache) and counted at one time.
LANES, SPAN = 1024, 4096
COUNT_TOKENS = 500_000
# Hashes of a word's first and last letters, by length (one or two) and letters.
ENDINGS = np.array([zlib.crc32(bytes([a])) for a in range(256)] + [zlib.crc32(bytes([a, b])) for a in range(256) for b in range(256)], np.int64)


def words_of(text: str | None) -> list[bytes]:
    """Tokens of a text; the empty string is its end."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), b""]


def token_ids(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """``words_of`` of all texts: numbers of the tokens, where each text starts, and the tokens by number."""
    lower = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    # Split at its last blank, a text has its end as an empty string; an empty text is one already.
    words = pc.ascii_split_whitespace(pc.if_else(pc.equal(lower, ""), lower, pc.binary_join_element_wise(lower, "", " ")))
    encoded = words.flatten().dictionary_encode()
    return encoded.indices.to_numpy(), words.offsets.to_numpy()[:-1].astype(np.int64) - words.offsets[0].as_py(), encoded.dictionary.cast(pa.binary())


def word_code(word: bytes) -> int:
    """Leaf (three bits each from the first and last letters) above the hash of the word."""
    head, tail = zlib.crc32(word[:2]) % 7 + 1, zlib.crc32(word[-2:]) >> 3 & 7
    leaf = (head << 3 | tail) if word else 0
    return leaf << HASH_BITS | zlib.crc32(word) >> 7 & (1 << HASH_BITS) - 1


def word_codes(words: list[bytes]) -> np.ndarray:
    """``word_code`` of every word."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer(b"".join(words) + b"  ", np.uint8).astype(np.int64)
    start = np.cumsum(size) - size
    last = start + np.maximum(size - 2, 0)
    head, tail = (ENDINGS[np.where(size > 1, 256 + letters[at] * 256 + letters[at + 1], letters[at])] for at in (start, last))
    leaf = np.where(size > 0, head % 7 + 1 << 3 | tail >> 3 & 7, 0)
    whole = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
    return (leaf << HASH_BITS | whole >> 7 & (1 << HASH_BITS) - 1).astype(np.int32)


def _mixed(prefix: np.ndarray, context: np.ndarray) -> np.ndarray:
    """A context of HASH_BITS bits of what precedes a symbol inside its token and before it."""
    mixed = prefix.astype(np.uint32) * np.uint32(0x9E3779B1) + context.astype(np.uint32) * np.uint32(0x85EBCA6B)
    return (mixed >> np.uint32(32 - HASH_BITS)).astype(np.int64)


def slots_of(symbol: int, code: np.ndarray, previous: np.ndarray, earlier: np.ndarray) -> list[np.ndarray]:
    """Contexts of a symbol by table: ``previous`` codes, and the leaves before those."""
    last, word = previous >> HASH_BITS, previous & (1 << HASH_BITS) - 1
    if symbol == 0:
        return [np.zeros_like(last), last, earlier << BITS | last, word]
    prefix = code >> HASH_BITS + BITS - symbol * BITS
    return [prefix & (1 << HASH_BITS) - 1, _mixed(prefix, 1 + last), _mixed(prefix, 1 + LEAVES + (earlier << BITS | last)), _mixed(prefix, 1 + LEAVES + LEAVES * LEAVES + previous)]


def symbol_of(codes: np.ndarray, symbol: int) -> np.ndarray:
    return codes >> HASH_BITS - symbol * BITS & LEAVES - 1


def contexts(codes: np.ndarray, first: np.ndarray, symbol: int = 0) -> tuple[np.ndarray, list[np.ndarray]]:
    """A symbol of every token (0: leaf), and its context for each context table; ``first``: starts of texts."""
    codes = codes.astype(np.int64)
    before = np.append(0, codes[:-1])
    before[first] = 0
    two = np.append(0, before[:-1])
    two[first] = 0
    return symbol_of(codes, symbol), slots_of(symbol, codes, before, two >> HASH_BITS)


def count_contexts(codes: np.ndarray, first: np.ndarray, into: np.ndarray) -> None:
    """Add the bits of all symbols; ``into`` holds the tables of the symbols one after the other."""
    begin = 0
    for symbol, all_slots in enumerate(SIZES):
        value, ctx = contexts(codes, first, symbol)
        starts, tables = (HASHED_STARTS, HASHED) if symbol else (STARTS, TABLES)
        for start, size, c in zip(starts, tables, ctx, strict=False):
            bits = into[2 * (begin + start) : 2 * (begin + start + size * LEAVES)].reshape(size, LEAVES, 2)
            # Values are counted once; a node's bits are the counts below it.
            counts = np.bincount(c * LEAVES + value, minlength=size * LEAVES).astype(into.dtype)
            for d in reversed(range(BITS)):
                pairs = counts.reshape(size, 1 << d, 2)
                bits[:, 1 << d : 2 << d] += pairs
                counts = pairs[..., 0] + pairs[..., 1]
        begin += all_slots


def stretched(counts: np.ndarray) -> np.ndarray:
    """Logit of a one in every slot."""
    c = counts.reshape(-1, 2).astype(np.float64) + 0.4
    return np.log(c[:, 1] / c[:, 0]).astype(np.float32)


def mix_bits(codes: np.ndarray, first: np.ndarray, table: np.ndarray, weights: np.ndarray, symbol: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """``mix_symbols`` of one symbol (0: leaf)."""
    return mix_symbols(codes, first, {symbol: table}, weights)


def mix_symbols(codes: np.ndarray, first: np.ndarray, tables: dict[int, np.ndarray], weights: np.ndarray, summed: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Natural logarithms of the probabilities of the symbols in ``tables``, summed by text; the texts' mean final weights by tokens.

    Texts are lanes side by side, each with its own weights and recent state to its end.
    The bits of a token share neither weights nor recent state, so they are one step.
    Without ``summed`` only the weights are worked out, and the sums are zero.
    """
    n = len(codes)
    size = np.diff(np.append(first, n))
    order = np.argsort(-size, kind="stable")
    by_text, final, looked = np.empty(len(first)), np.zeros(weights.T.shape), _Steps(tables, min(LANES, len(first)))
    for begin in range(0, len(order), LANES):
        some = order[begin : begin + LANES]
        by_text[some], last = _mix_lanes(codes, first[some], size[some], looked, weights, summed)
        final += last.astype(np.float64) @ size[some]
    return by_text, final.T / n if n else weights


class _Steps:
    """What no weight decides of several steps at once, in arrays that are used again."""

    def __init__(self, tables: dict[int, np.ndarray], lanes: int) -> None:
        self.tables, most = tables, max(SPAN, lanes) * BITS
        self.floats = np.empty((INPUTS + 1) * len(tables) * most, np.float32)
        self.longs = np.empty((len(tables) + 2) * most, np.int64)

    def look_up(self, row: np.ndarray, code: np.ndarray, previous: np.ndarray, earlier: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The tables' inputs (input, symbol, step, bit, lane; the last is left free), bits and places of the recent state (step, symbol, bit, lane)."""
        n, one = len(self.tables), (len(code), BITS, code.shape[1])
        all_of = (one[0], n, *one[1:])
        each = one[0] * one[1] * one[2]
        inputs = self.floats[: INPUTS * n * each].reshape(INPUTS, n, *one)
        bits = self.floats[INPUTS * n * each : (INPUTS + 1) * n * each].reshape(all_of)
        places = self.longs[: n * each].reshape(all_of)
        nodes, slots = self.longs[n * each : (n + 2) * each].reshape(2, *one)
        for at, (symbol, table) in enumerate(self.tables.items()):
            path = (symbol_of(code, symbol) | LEAVES).astype(np.int64)[:, None]
            np.right_shift(path, SHIFTS, nodes)
            np.add(nodes, row + at * LEAVES, places[:, at])
            bits[:, at] = path.astype(np.uint8) >> SHIFTS.astype(np.uint8) - 1 & 1
            for i, (slot, start) in enumerate(zip(slots_of(symbol, code, previous, earlier), HASHED_STARTS if symbol else STARTS, strict=False)):
                np.add(slot.astype(np.int64)[:, None] * LEAVES + start, nodes, slots)
                table.take(slots, out=inputs[i, at], mode="clip")  # no slot is outside; without a mode ``out`` is copied
        return inputs, bits, places


def _mix_lanes(codes: np.ndarray, start: np.ndarray, size: np.ndarray, looked: _Steps, weights: np.ndarray, summed: bool) -> tuple[np.ndarray, np.ndarray]:
    """The sums of ``mix_symbols`` for texts of falling ``size``, and the weights (input, bit, text) they end with."""
    lanes, most, n = len(start), int(size[0]), len(looked.tables)
    w = np.repeat(weights.T.astype(np.float32)[:, :, None], lanes, 2).reshape(INPUTS, n, BITS, lanes)
    recent = np.zeros(lanes * n * LEAVES, np.float32)
    total = np.zeros(lanes)
    row = np.arange(lanes) * n * LEAVES
    before = two = np.zeros(lanes, codes.dtype)
    pace = np.float32(4 * RECENT)
    t = 0
    while t < most:
        m = int(np.searchsorted(-size, -t, "left"))
        steps = min(max(1, SPAN // m), most - t)
        at = np.arange(t, t + steps)[:, None]
        code = codes.take(start[:m] + at, mode="clip")
        previous = np.concatenate([before[None, :m], code[:-1]])
        last = previous >> HASH_BITS
        inputs, bits, places = looked.look_up(row[:m], code, previous, np.concatenate([two[None, :m], last[:-1]]))
        # A text that has ended within these steps moves nothing and counts for nothing.
        there = at < size[:m]
        signs = (1 - 2 * bits) * there[:, None, None]
        pull = -RATE * signs
        against, above = np.empty((2, *bits.shape), np.float32)
        own_w, product, logit = w[..., :m], np.empty((INPUTS, *bits.shape[1:]), np.float32), np.empty(bits.shape[1:], np.float32)
        for i in range(steps):
            s, odds, one_more = inputs[:, :, i], against[i], above[i]
            lately = recent.take(places[i])
            s[-1] = lately
            np.multiply(own_w, s, product)
            np.add.reduce(product, 0, out=logit)
            np.minimum(np.maximum(logit, -20, logit), 20, logit)
            np.exp(np.multiply(logit, signs[i], odds), odds)
            np.add(odds, 1, one_more)
            np.multiply(np.divide(odds, one_more, logit), pull[i], logit)
            np.add(own_w, np.multiply(s, logit, product), own_w)
            # lately + pace * (bit - 1 / (1 + exp(-lately)))
            np.divide(1, np.add(np.exp(np.negative(lately, logit), logit), 1, logit), logit)
            np.add(lately, np.multiply(np.subtract(bits[i], logit, logit), pace, logit), logit)
            recent[places[i]] = np.minimum(np.maximum(logit, -6, logit), 6, logit)
        if summed:
            # log1p(odds): the logarithm of 1 + odds, and what its rounding left out.
            against -= above - 1
            against /= above
            against += np.log(above, above)
            total[:m] -= (against.sum((1, 2), dtype=np.float64) * there).sum(0)
        before, two = code[-1], last[-1]
        t += steps
    return total, w.reshape(INPUTS, -1, lanes)


def by_symbol(logits: np.ndarray) -> list[np.ndarray]:
    """The tables of the symbols (the leaves', or all)."""
    ends = np.cumsum(SIZES).tolist()
    return [logits[end - size : end] for size, end in zip(SIZES, ends, strict=True) if end <= len(logits)]


def _runs(texts: pa.Array, chars: int) -> Iterator[pa.Array]:
    """Neighbouring texts of at most ``chars`` bytes together, or one longer text."""
    sizes = np.array([0 if n is None else n for n in pc.binary_length(texts).to_pylist()], np.int64)
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and held + n > chars:
            yield texts.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield texts.slice(begin)


def _joined(parts: list[tuple[np.ndarray, np.ndarray, pa.Array]]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Neighbouring parts of ``token_ids`` as one; a token that several hold has several numbers."""
    if not parts:
        return np.empty(0, np.int32), np.empty(0, np.int64), pa.array([], pa.binary())
    tokens = np.cumsum([0, *[len(ids) for ids, _, _ in parts]])
    kinds = np.cumsum([0, *[len(words) for _, _, words in parts]])
    ids = np.concatenate([ids + np.int32(k) for (ids, _, _), k in zip(parts, kinds, strict=False)])
    first = np.concatenate([first + n for (_, first, _), n in zip(parts, tokens, strict=False)])
    return ids, first, pa.concat_arrays([words for _, _, words in parts])


class Codes(dict):
    """Codes of the words that were met."""

    def __missing__(self, word: bytes) -> int:
        code = self[word] = word_code(word)
        return code


def _codes(texts: list[list[bytes]], known: Codes) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = np.fromiter(map(known.__getitem__, chain.from_iterable(texts)), np.int32, int(sizes.sum()))
    return codes, np.cumsum(sizes) - sizes


def start_weights(texts: DataFrame, logits: np.ndarray) -> np.ndarray:
    """The mean by tokens of the weights that all ``texts`` (text) end with; every task adds up its own.

    ``logits``: the tables of the leaves alone, or of all symbols one after the other; the weights come likewise (BITS rows a symbol).
    """
    tables = dict(enumerate(by_symbol(logits)))
    names = ["tokens", *[f"w{i}" for i in range(len(tables) * BITS * INPUTS)]]
    first_weights = np.full((len(tables) * BITS, INPUTS), FIRST_WEIGHT)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(names))
        for batch in batches:
            for run in _runs(batch.column("text"), RUN_BYTES):
                ids, first, words = token_ids(run)
                sums += len(ids) * np.append(1.0, mix_symbols(word_codes(words.to_pylist())[ids], first, tables, first_weights, summed=False)[1])
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in sums], names)

    trained = texts.select("text").mapInArrow(train, ", ".join(f"{c} double" for c in names))
    r = trained.agg(*[F.sum(c).alias(c) for c in names]).first()
    return np.array(r[1:]).reshape(-1, INPUTS) / r[0] if r[0] else first_weights


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's words with their training counts; at the end the task's context counts."""
    names = ["block", "token", "n", "chunk", "counts"]
    table = np.zeros(2 * sum(SIZES), np.int64)

    def learn(block: int | None, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks()
        ids, first, words = token_ids(rows.column("text").combine_chunks())
        train = ~rows.column("held_out").to_numpy()
        size = np.diff(np.append(first, len(ids)))
        ids = ids[np.repeat(train, size)]
        codes, size = word_codes(words.to_pylist()), size[train]
        first, last = np.cumsum(size) - size, np.cumsum(size)
        begin = 0
        while begin < len(size):
            end = max(begin + 1, int(np.searchsorted(last, first[begin] + COUNT_TOKENS, "right")))
            count_contexts(codes[ids[first[begin] : last[end - 1]]], first[begin:end] - first[begin], table)
            begin = end
        n = len(words)
        return pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), words, pa.array(np.bincount(ids, minlength=n), pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)

    # Neighbouring rows of a block, of RUN_BYTES together or a little more.
    open_block, parts, held = None, [], 0
    for batch in batches:
        at = 0
        for some in _runs(batch.column("text"), RUN_BYTES):
            blocks = batch.column("block").slice(at, len(some))
            number, none = pc.fill_null(blocks, 0).to_numpy(), blocks.is_null().to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(number) | np.diff(none)) + 1).tolist(), len(blocks)]
            for begin, end in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(at + begin, end - begin)
                block = part.column("block")[0].as_py()
                if parts and (block != open_block or held > RUN_BYTES):
                    yield learn(open_block, parts)
                    parts, held = [], 0
                open_block = block
                parts.append(part)
                held += some.slice(begin, end - begin).nbytes
            at += len(some)
    if parts:
        yield learn(open_block, parts)
    chunks = [i for i in range(0, len(table), CHUNK) if table[i : i + CHUNK].any()]
    rows = len(chunks)
    yield pa.RecordBatch.from_arrays([pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.binary()), pa.nulls(rows, pa.int64()), pa.array([i // CHUNK for i in chunks], pa.int32()), pa.array([zlib.compress(table[i : i + CHUNK].tobytes(), 1) for i in chunks], pa.binary())], names)


def _summed(group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(zlib.decompress(x), np.int64) for x in group.column("counts").to_pylist())
    return pa.table({"chunk": group.column("chunk")[:1], "counts": pa.array([total.astype(np.int64).tobytes()], pa.binary())})


def score_texts(docs: DataFrame, held_out: Column, block: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    ``held_out``: a column of ``docs`` that marks texts not learned from (null:
    held out).  ``block``: a number that few, neighbouring rows share; without
    it rows are dealt by hash.  A null text is empty and has only its end.
    Scores are base 10.  Rows that repeat an id are rows like others.  An empty
    table gives an empty result.  Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    if block is None:
        chars = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
        block = F.pmod(F.xxhash64(id_col), F.lit(1 + chars // BLOCK_CHARS))
        rows = docs.select(F.col(id_col).alias("doc_id"), block.alias("block"), F.coalesce(held_out, F.lit(True)).alias("held_out"), F.col(text_col).alias("text"))
        rows = rows.repartition("block").sortWithinPartitions("block")
    else:
        rows = docs.select(F.col(id_col).alias("doc_id"), block.cast("long").alias("block"), F.coalesce(held_out, F.lit(True)).alias("held_out"), F.col(text_col).alias("text"))

    learned = rows.select("block", "held_out", "text").mapInArrow(_learn, "block long, token binary, n long, chunk int, counts binary")
    learned = staged(learned, "lm-learned")
    # Every block's words with the corpus count; a token has at most a row a block (or two).
    every = Window.partitionBy("token").orderBy("block")
    total = F.sum("n").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    counted = learned.filter("token IS NOT NULL").select("block", "token", total.alias("c"), F.row_number().over(every).alias("nth"))
    counted = staged(counted, "lm-counted")

    table = np.zeros(2 * sum(SIZES), np.int64)
    parts = learned.filter("chunk IS NOT NULL").select("chunk", "counts").groupBy("chunk").applyInArrow(_summed, "chunk int, counts binary")
    for r in parts.collect():  # the tables' fixed size: about 42 MB
        table[r["chunk"] * CHUNK : r["chunk"] * CHUNK + len(r["counts"]) // 8] = np.frombuffer(r["counts"], np.int64)
    logits = stretched(table)

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((4, KINDS))
        for batch in batches:
            c = batch.column("c").to_numpy().astype(float)
            at = word_codes(batch.column("token").to_pylist())
            for i, x in enumerate((c, c + 0.1, c == 1, np.ones(len(c)))):
                sums[i] += np.bincount(at, weights=x, minlength=KINDS)
        some = np.flatnonzero(sums[3])
        yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(x[some]) for x in sums]], ["code", "tokens", "mass", "once", "kinds"])

    vocabulary = counted.filter("nth = 1 AND c > 0").select("token", "c")
    by_code = vocabulary.mapInArrow(classes, "code long, tokens double, mass double, once double, kinds double")
    found = by_code.groupBy("code").agg(*[F.sum(c).alias(c) for c in ("tokens", "mass", "once", "kinds")]).toArrow()  # at most KINDS rows: about 10 MB
    stats = np.zeros((KINDS, 4))
    stats[found.column("code").to_numpy()] = np.stack([found.column(c).to_numpy() for c in ("tokens", "mass", "once", "kinds")], 1)
    n_train, n_kinds = int(stats[:, 0].sum()), int(stats[:, 3].sum())
    unseen = np.clip((stats[:, 2] + 0.5) / (stats[:, 0] + 1), 1e-6, 0.9)
    log_mass, log_seen, log_unseen = np.log10(np.maximum(stats[:, 1], 0.1)), np.log10(1 - unseen), np.log10(unseen)
    log_all = np.log10(n_train + 0.1 * (n_kinds + 1))

    train = docs.select(F.coalesce(held_out, F.lit(True)).alias("held_out"), F.col(text_col).alias("text")).filter("NOT held_out")
    start = start_weights(train, logits)
    tables = dict(enumerate(by_symbol(logits)))

    def score(texts: pa.Table, words: pa.Table) -> pa.Table:
        column = texts.column("text").combine_chunks()
        parts = [token_ids(run) for run in _runs(column, RUN_BYTES)]
        ids, first, found = _joined(parts)
        known = words.column("token").combine_chunks()
        c = words.column("c").to_numpy()[pc.index_in(found, value_set=known).to_numpy()].astype(float)
        codes = word_codes(found.to_pylist())
        base = np.log10(c + 0.1) - log_all
        inside = np.where(c > 0, log_seen[codes] + np.log10(c + 0.1) - log_mass[codes], log_unseen[codes])
        sizes = np.diff(np.append(first, len(ids)))
        joined = {"n": sizes, "known": sizes, "base": np.empty(0), "score": np.empty(0)}
        if len(first):
            bits, _ = mix_symbols(codes[ids], first, tables, start)
            joined["known"] = np.add.reduceat((c[ids] > 0).astype(np.int64), first)
            joined["base"] = np.add.reduceat(base[ids], first)
            joined["score"] = bits / np.log(10) + np.add.reduceat(inside[ids], first)
        size = np.maximum(1, pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
        return pa.table({
            "doc_id": texts.column("doc_id"), "held_out": texts.column("held_out"), "n_tokens": pa.array(joined["n"], pa.int64()),
            "n_known": pa.array(joined["known"], pa.int64()), "train_tokens": pa.array(np.full(len(column), n_train), pa.int64()),
            "base_score": pa.array(joined["base"], pa.float64()), "score": pa.array(joined["score"], pa.float64()),
            "bits_per_byte": pa.array(-joined["score"] / np.log10(2) / size, pa.float64()),
        })

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    words = counted.select("block", "token", "c")  # a block that two tasks read holds a word twice, with one count
    return rows.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(score, schema)
