import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm.bpe import Encoder, MergeReplay, encode_documents

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


LIBRARY = library()
with open(PATH, "rb") as f:
    ENCODER = Encoder(f.read(), public_tokenizers.PATTERN)

TEXTS = [
    None, "", " ", "a", "  two  spaces ", "it's we'll 'quoted'", "é́à ñandú Übergröße", "tab\tnew\n\n\nline \r\n", "\x1c\x1d\x85\xa0 x᠎",
    "=" * 3000, "aaaaaaaaaaaaaaaaaaaaaaa" * 40, "日本語のテキスト と 中文", "🙂🙃" * 30, "x" * 20_000, "1234567890 12 ½ Ⅷ", "<|endoftext|>", "abcabcabc" * 100, "\u0000﻿￿",
]


@pytest.mark.parametrize("text", TEXTS)
def test_same_ids_as_the_library(text):
    ids = np.frombuffer(ENCODER.encode([text or ""])[0], "<u4").tolist()
    assert ids == LIBRARY.encode_ordinary(text or "")
    assert ENCODER.decode(np.array(ids, "<u4").tobytes()) == (text or "").encode()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(), max_size=6))
def test_same_ids_on_any_texts(texts):
    got = [np.frombuffer(x, "<u4").tolist() for x in ENCODER.encode(texts)]
    assert got == [LIBRARY.encode_ordinary(t) for t in texts]


def plain(ranks, word):
    """Merge the leftmost pair of the lowest rank until none is left."""
    if word in ranks:
        return [ranks[word]]
    parts = [bytes([b]) for b in word]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_replay_equals_plain_merging_for_any_rank_order():
    # Random vocabularies, where a merge can open one of a lower rank.
    rng = random.Random(3)
    for _ in range(150):
        tokens = {bytes(rng.choice(b"ab") for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(0, 14))}
        order = sorted(tokens)
        rng.shuffle(order)
        ranks = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate(order)}
        words = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 24))) for _ in range(12)]
        got = [x.tolist() for x in MergeReplay(ranks).encode(words)]
        assert got == [plain(ranks, w) for w in words]


def test_rows(spark):
    rows = [(i, t, i) for i, t in enumerate(TEXTS)] + [(None, "no id", 0), (3, "a", 0), (3, "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in encode_documents(docs, PATH, public_tokenizers.PATTERN).collect())
    want = []
    for i, t, _ in rows:
        ids = LIBRARY.encode_ordinary(t or "")
        want.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert encode_documents(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
