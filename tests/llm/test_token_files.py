import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from scriptorium.llm.token_files import WordEncoder, read_token_files, write_token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "It's ÉTÉ été ΟΔΟΣ İstanbul", "\x1cfile\x1dsep x", "a\x85b\xa0c d", "日本語 text", "<|endoftext|>x <|startoftext|>", "x" * 5000, "́ lead", "1 22 333's 'll", "tab\tnew\nline"]


LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_chunks_give_the_librarys_ids():
    with open(PATH, encoding="utf-8") as f:
        encoder = WordEncoder(f.read(), "<u2")
    rng = random.Random(1)
    texts = [t or "" for t in ODD] + ["".join(rng.choice("ab é́\n'1.\x1f ß漢") for _ in range(60)) for _ in range(200)]
    assert [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(texts)] == [ids_of(t) for t in texts]


def test_round_trip(spark):
    rng = random.Random(4)
    rows = [(rng.randint(-50, 10**12), rng.choice(ODD), "k", 1) for _ in range(300)] + [(None, "null id", "k", 1), (5, "twice", "k", 1), (5, "twice", "k", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, part int").repartition(7)
    manifest = write_token_files(docs, PATH, end_id=1)
    got = sorted(read_token_files(spark, manifest, batch_docs=10).collect(), key=lambda r: r["start"])
    assert len(got) == len(rows)
    keys = [-(10**15) if r["doc_id"] is None else r["doc_id"] for r in got]
    assert keys == sorted(keys)
    start = 0
    want = {}
    for i, t, *_ in rows:
        ids = np.array([*ids_of(t), 1], "<u4")
        want.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
        want[r["doc_id"]].remove((r["n_tokens"], r["ids_crc32"]))
    # The files hold the same ids end to end.
    parts = manifest.sort("part").collect()
    flat = np.concatenate([np.fromfile(p["ids"].removeprefix("file://"), "<u2") for p in parts])
    assert len(flat) == start and sum(p["n_docs"] for p in parts) == len(rows)


def test_empty_table(spark):
    manifest = write_token_files(spark.createDataFrame([], "doc_id long, text string"), PATH)
    assert manifest.count() == 0 and read_token_files(spark, manifest).count() == 0
