"""The pipeline's stages against brute force on small documents."""

import hashlib
import random

import public_tokenizers
import tiktoken
from tiktoken.load import load_tiktoken_bpe

import corpus_pipeline as P


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def similar(a, b):
    return bool(a) and bool(b) and 100 * len(a & b) >= 75 * len(a | b)


def documents(spark, rows):
    full = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def rows():
    rng = random.Random(9)
    base = [" ".join(f"w{rng.randint(0, 400)}" for _ in range(40)) for _ in range(8)]
    out = []
    for i in range(60):
        words = rng.choice(base).split()
        if rng.random() < 0.5:
            words[rng.randrange(len(words))] = f"e{i}"
        own = " ".join(f"o{i}x{j}" for j in range(rng.randint(6, 30)))
        out.append((i, rng.choice([own, " ".join(words), own + "\n" + " ".join(words)]), rng.choice(["a", "a", "b", None])))
    return out + [(90, None, "a"), (91, "", "b"), (92, "solo", "b"), (93, "solo", "b")]


def test_lines(spark):
    data, kept, seen = rows(), {}, []
    for i, text, _ in data:
        left = []
        for line in (text or "").split("\n"):
            s = shingles(line)
            if not any(similar(s, t) for t in seen):
                left.append(line)
            if s:
                seen.append(s)
        kept[i] = (text if text is None else "\n".join(left), text is not None and left != text.split("\n"))
    want = {i: t for i, (t, changed) in kept.items() if not changed or t.split()}
    want = {i: t for i, t in want.items() if t is not None}
    got = {r.doc_id: r.text for r in P.lines(spark, documents(spark, data), "").collect()}
    assert {i: t for i, t in got.items() if t is not None} == want


def test_near_copies(spark):
    data = rows()
    parent = {i: i for i, _, _ in data}

    def root(i):
        return i if parent[i] == i else root(parent[i])

    sets = [(i, shingles(t or "")) for i, t, _ in data]
    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if similar(a, b):
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    got = {r.doc_id for r in P.near_copies(spark, documents(spark, data), "").collect()}
    assert got == {i for i, _, _ in data if root(i) == i}


def test_tokens(spark):
    data = rows()
    ranks = load_tiktoken_bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("fixture", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in P.tokens(spark, documents(spark, data), "").collect()}
    for i, text, _ in data:
        ids = enc.encode_ordinary(text or "")
        assert got[i] == (len(ids), hashlib.sha256(b"".join(t.to_bytes(4, "little") for t in ids)).hexdigest())


LONG = " ".join(f"w{i}" for i in range(40))


def odd_rows():
    """Null ids and an id that repeats, with equal and with other texts."""
    other = " ".join(f"v{i}" for i in range(40))
    return [(None, LONG, "a"), (None, LONG, "a"), (4, LONG, "a"), (5, LONG + " end", "a"), (5, other, "a"), (5, other, "b"), (9, other + " end", "b"), (None, "lone text", "b")]


def test_near_copies_without_or_with_repeated_ids(spark):
    got = sorted((str(r.doc_id), r.text.split()[0]) for r in P.near_copies(spark, documents(spark, odd_rows()), "").collect())
    assert got == [("5", "v0"), ("None", "lone"), ("None", "w0")]


def test_lines_without_or_with_repeated_ids(spark):
    got = sorted((str(r.doc_id), r.text.split()[0]) for r in P.lines(spark, documents(spark, odd_rows()), "").collect())
    assert got == [("5", "v0"), ("None", "lone"), ("None", "w0")]


def test_mix_takes_rows_without_or_with_repeated_ids(spark):
    # Sources take different whole repeats: a row has its own source's.
    data = [(None, "x y", "a"), (1, "p " * 30, "a"), (1, "q", "b"), (2, "r", "b"), (None, "s", "b")]
    docs = P.keyed(documents(spark, data))
    want = {r[P.ROW]: r.repeats for r in P.mix(docs, row_col=P.ROW).collect()}
    assert len(want) == len(data)
    by_row = {r[P.ROW]: (r.doc_id, r.text) for r in docs.collect()}
    expected = sorted(str(by_row[k]) for k, n in want.items() for _ in range(n))
    got = sorted(str((r.doc_id, r.text)) for r in P.mixed(spark, docs, "").collect())
    assert got == expected and any("None" in x for x in got)


def test_quality_rejects_by_row(spark, monkeypatch):
    good = " ".join(f"Plain sentence number {i} reads well." for i in range(9))
    bad = "!!! $$$ " * 40
    data = [(i, good + f" {i}" if i % 2 else bad + f"{i}", "a") for i in range(60)] + [(None, bad, "a"), (None, good, "a"), (70, good, "a"), (70, bad, "a")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    monkeypatch.setattr(P, "table", lambda *_: labels)
    got = sorted((str(r.doc_id), r.text[0]) for r in P.quality(spark, documents(spark, data), "").collect())
    assert got == sorted([(str(i), "P") for i in range(1, 60, 2)] + [("None", "P"), ("70", "P")])
