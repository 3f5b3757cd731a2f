import random
from collections import Counter
from math import log10

import numpy as np
from pyspark.sql import functions as F

from scriptorium.llm.context_mixing import BITS, INPUTS, LEAVES, STARTS, contexts, mix_bits, score_texts, words_of


def held():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0


def corpus():
    rng = random.Random(2)
    tongue = [["the", "of", "and", *[f"th{i}ing" for i in range(60)]], ["der", "und", *[f"sch{i}keit" for i in range(60)]]]
    rows = []
    for i in range(240):
        words = [rng.choice(tongue[i % 2]) for _ in range(rng.randint(1, 120))] + ([f"only{i}"] if i % 3 == 0 else [])
        rows.append((i, " ".join(words)))
    return rows + [(900, None), (901, ""), (902, "THE  the\tThe É é"), (None, "no id"), (903, "the " * 3000), (5, rows[5][1])]


def test_base_scores_are_exact_and_the_model_beats_them(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 0.0, 1) for r in rows], "doc_id long, text string, score double, block int").repartition(5)
    marks = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.coalesce(held(), F.lit(True)).alias("h")).collect()}
    got = score_texts(docs, held()).collect()
    assert len(got) == len(rows)
    counts = Counter(w for i, t in rows if not marks[i] for w in words_of(t))
    n = sum(counts.values())
    for r in got:
        words = next(words_of(t) for i, t in rows if i == r["doc_id"])
        assert r["n_tokens"] == len(words) and r["n_known"] == sum(counts[w] > 0 for w in words) and r["train_tokens"] == n
        base = sum(log10((counts[w] + 0.1) / (n + 0.1 * (len(counts) + 1))) for w in words)
        assert abs(base - r["base_score"]) < 1e-6 * max(1, abs(base))
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_same_scores_by_any_blocks(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    a = sorted((str(r["doc_id"]), round(r["score"], 4)) for r in score_texts(docs, held()).collect())
    b = sorted((str(r["doc_id"]), round(r["score"], 4)) for r in score_texts(docs.repartition(9), held(), F.pmod(F.xxhash64("text"), F.lit(13))).collect())
    assert a == b
    assert score_texts(docs.limit(0), held()).count() == 0


def test_probabilities_of_all_leaves_sum_to_one():
    rng = np.random.default_rng(4)
    table = rng.normal(0, 1, STARTS[-1]).astype(np.float32)
    weights = rng.uniform(0, 0.5, (BITS, INPUTS))
    prefix = rng.integers(0, LEAVES, 5) << 12
    total = 0.0
    alone, _ = mix_bits(prefix, np.array([0]), table, weights)
    for leaf in range(LEAVES):
        codes = np.append(prefix, leaf << 12)
        total += np.exp(mix_bits(codes, np.array([0]), table, weights)[0][0] - alone[0])
    assert abs(total - 1) < 1e-4
    assert contexts(prefix, np.array([0]))[1][1][0] == 0


def one_text(leaves, table, weights):
    """Log probability and final weights of one text, bit by bit, with one state from its first to its last token."""
    w, recent, total = weights.astype(float).copy(), [0.0] * LEAVES, 0.0
    _, ctx = contexts(leaves << 12, np.array([0]))
    for t, leaf in enumerate(leaves):
        node = 1
        for d in range(BITS):
            bit = int(leaf) >> (BITS - 1 - d) & 1
            s = np.array([*(table[c[t] * LEAVES + STARTS[i] + node] for i, c in enumerate(ctx)), recent[node]], float)
            odds = np.exp(-(2 * bit - 1) * np.clip(w[d] @ s, -20, 20))
            total -= np.log1p(odds)
            w[d] += 0.02 * (2 * bit - 1) * odds / (1 + odds) * s
            recent[node] = float(np.clip(recent[node] + 0.24 * (bit - 1 / (1 + np.exp(-recent[node]))), -6, 6))
            node = node * 2 + bit
    return total, w


def test_a_long_text_keeps_its_weights_and_state():
    rng = np.random.default_rng(5)
    table = rng.normal(0, 1, STARTS[-1]).astype(np.float32)
    weights = np.full((BITS, INPUTS), 0.3)
    texts = [rng.choice([3, 17, 40], 900), rng.choice([8, 60], 5)]
    got, final = mix_bits(np.concatenate(texts) << 12, np.array([0, 900]), table, weights)
    want = [one_text(x, table, weights) for x in texts]
    assert np.allclose(got, [x[0] for x in want], rtol=1e-3)
    assert np.allclose(final, (900 * want[0][1] + 5 * want[1][1]) / 905, atol=1e-3)


def test_start_weights_come_from_all_training_texts(spark):
    from scriptorium.llm import context_mixing as M

    rng = random.Random(6)
    # More copies of one text than the sample once held, and others.
    texts = ["same old text again"] * 450 + [" ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.randint(1, 40))) for _ in range(150)]
    table = np.random.default_rng(6).normal(0, 1, STARTS[-1]).astype(np.float32)
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(7)
    sums, n = 0.0, 0
    for t in texts:
        codes, first = M._codes([words_of(t)], M.Codes())
        sums, n = sums + len(codes) * mix_bits(codes, first, table, np.full((BITS, INPUTS), 0.3))[1], n + len(codes)
    assert np.allclose(M.start_weights(docs, table), sums / n, atol=1e-9)


def test_every_bit_of_a_word_is_mixed():
    from scriptorium.llm import context_mixing as M

    # Which word of a leaf comes is told by the word before it, not by its share.
    words = [f"th{i}ing".encode() for i in range(400)]
    leaf = M.word_code(words[0]) >> M.HASH_BITS
    a, b, x, y = [w for w in words if M.word_code(w) >> M.HASH_BITS == leaf][:4]
    texts = [[p, q, b""] for p, q in ((a, x), (b, y)) for _ in range(200)]
    table = np.zeros(2 * sum(M.SIZES), np.int64)
    codes, first = M._codes(texts, M.Codes())
    M.count_contexts(codes, first, table)
    tables = M.by_symbol(M.stretched(table))

    def score(text):
        codes, first = M._codes([[*text, b""]], M.Codes())
        return sum(M.mix_bits(codes, first, t, np.full((BITS, INPUTS), 0.3), s)[0][0] for s, t in enumerate(tables))

    assert score([a, x]) > score([a, y]) + 1 and score([b, y]) > score([b, x]) + 1
    # The values of each later symbol have probabilities that sum to one.
    for s in (1, 2):
        rng, shift = np.random.default_rng(s), M.HASH_BITS - s * M.BITS
        logits, prefix, weights = rng.normal(0, 1, M.SIZES[s]).astype(np.float32), rng.integers(0, M.KINDS, 4), rng.uniform(0, 0.5, (BITS, INPUTS))
        alone = mix_bits(prefix, np.array([0]), logits, weights, s)[0][0]
        last = int(M.word_code(a)) >> shift + BITS << shift + BITS
        assert abs(sum(np.exp(mix_bits(np.append(prefix, last | v << shift), np.array([0]), logits, weights, s)[0][0] - alone) for v in range(LEAVES)) - 1) < 1e-4


def test_words_of_one_leaf_are_scored_by_their_neighbours(spark):
    a, b, x, y = [w.decode() for w in [f"th{i}ing".encode() for i in range(400)] if _leaf(w) == _leaf(b"th0ing")][:4]
    rows = [(i, f"{a} {x}" if i % 2 else f"{b} {y}") for i in range(400)] + [(1000, f"{a} {x}"), (1001, f"{a} {y}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in score_texts(docs, F.col("doc_id") >= 1000).where("held_out").collect()}
    assert got[1000] > got[1001] + 0.5


def _leaf(word):
    from scriptorium.llm.context_mixing import HASH_BITS, word_code

    return word_code(word) >> HASH_BITS


def test_tokens_and_codes_of_many_texts_at_once():
    import pyarrow as pa
    from scriptorium.llm import context_mixing as M

    texts = ["The  THE\tthe", None, "", " ", "\x0b a\x0cb\r\n", "é É x y", "a\x1cb \x85 \x00", "one", " lead", "trail "]
    column = pa.array(["before", *texts]).slice(1)
    ids, first, words = M.token_ids(column)
    ends = [*first[1:].tolist(), len(ids)]
    assert [[words[i].as_py() for i in ids[a:b]] for a, b in zip(first, ends, strict=True)] == [words_of(t) for t in texts]
    kinds = [b"", b"a", b"ab", b"abc", "é".encode(), *(f"w{i}".encode() for i in range(500))]
    assert M.word_codes(kinds).tolist() == [M.word_code(w) for w in kinds] and M.word_codes([]).tolist() == []


def test_symbols_and_groups_of_texts_together_give_what_each_gives_alone(monkeypatch):
    from scriptorium.llm import context_mixing as M

    rng = np.random.default_rng(9)
    sizes = rng.integers(1, 40, 23)
    codes, first = rng.integers(0, M.KINDS, sizes.sum()).astype(np.int32), np.cumsum(sizes) - sizes
    tables = {s: rng.normal(0, 1, size).astype(np.float32) for s, size in enumerate(M.SIZES)}
    weights = rng.uniform(0, 0.5, (M.SYMBOLS * BITS, INPUTS))
    monkeypatch.setattr(M, "LANES", 5)
    monkeypatch.setattr(M, "SPAN", 16)
    got, final = M.mix_symbols(codes, first, tables, weights)
    want, ends = np.zeros(len(first)), np.zeros(weights.shape)
    for s, table in tables.items():
        own = slice(s * BITS, (s + 1) * BITS)
        for i, (a, n) in enumerate(zip(first, sizes, strict=True)):
            alone, last = mix_bits(codes[a : a + n], np.array([0]), table, weights[own], s)
            want[i] += alone[0]
            ends[own] += n * last / sizes.sum()
    assert np.allclose(got, want, rtol=1e-5) and np.allclose(final, ends, atol=1e-5)
    counts = np.zeros(2 * sum(M.SIZES), np.int64)
    M.count_contexts(codes, first, counts)
    # Every bit of every symbol is counted once in each context table.
    assert counts.sum() == len(codes) * M.SYMBOLS * BITS * len(M.TABLES)
