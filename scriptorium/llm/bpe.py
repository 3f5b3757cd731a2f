"""Byte-level BPE by merge replay over the words of a corpus slice.

The distinct words (pre-tokens) of a slice lie end to end in one array of
tokens.  An inverted index maps each merge's rank to the positions where its
pair stands.  Merges are applied in rank order, all positions of a rank at
once, and only the pairs with the touched neighbours enter the index again.
Words are encoded once for a slice and its documents are put together from
them; slices are bounded by their bytes, so memory is bounded by the slice and
the word table, not by the partition.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

NONE = np.iinfo(np.int32).max
SLICE_CHARS = 8_000_000
KEPT_WORDS = 600_000


def _distinct(positions: np.ndarray) -> np.ndarray:
    ordered = np.sort(positions)
    return ordered[np.append(True, ordered[1:] != ordered[:-1])] if len(ordered) else ordered


class MergeReplay:
    """A vocabulary of ranks (token bytes -> id, the id being the merge's rank)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int32)
        # The lowest rank of a merge that takes a given token: below the
        # token's own rank, equal pairs of a word have to be merged one by one.
        self.lowest = np.full(len(self.tokens), NONE, np.int32)
        if len(self.pair_keys):
            np.minimum.at(self.lowest, self.pair_keys >> 32, self.pair_ranks)
            np.minimum.at(self.lowest, self.pair_keys & 0xFFFFFFFF, self.pair_ranks)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.pair_keys):
            return np.full(len(left), NONE, np.int32)
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NONE)

    def encode(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of every word."""
        out: list = [None] * len(words)
        todo = []
        for i, word in enumerate(words):
            rank = self.ranks.get(word)
            if rank is None and word:
                todo.append(i)
            else:
                out[i] = np.array([] if rank is None else [rank], np.uint32)
        if todo:
            for i, ids in zip(todo, self._replay([words[i] for i in todo]), strict=True):
                out[i] = ids
        return out

    def _replay(self, words: list[bytes]) -> list[np.ndarray]:
        ends = np.cumsum([len(w) for w in words])
        n = int(ends[-1])
        tok = np.append(self.byte_ids[np.frombuffer(b"".join(words), np.uint8)], -1)
        nxt, prv = np.arange(1, n + 2), np.arange(-1, n)
        nxt[ends - 1] = n
        prv[np.append(0, ends[:-1])] = n
        word = np.repeat(np.arange(len(words)), np.diff(ends, prepend=0))
        rank = np.full(n + 1, NONE, np.int32)
        inner = np.flatnonzero(nxt[:n] < n)
        rank[inner] = self.pair_rank(tok[inner], tok[inner + 1])
        alive = np.ones(n, bool)

        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def post(positions: np.ndarray) -> None:
            ranks = rank[positions]
            found = ranks != NONE
            positions, ranks = positions[found], ranks[found]
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for r, part in zip(ranks[np.append(0, cuts)].tolist() if len(ranks) else (), np.split(positions, cuts), strict=False):
                if r not in index:
                    index[r] = []
                    heapq.heappush(heap, r)
                index[r].append(part)

        post(inner)
        while heap:
            r = heapq.heappop(heap)
            at = _distinct(np.concatenate(index.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            if self.lowest[r] <= r:
                first = np.append(True, word[at[1:]] != word[at[:-1]])
                later, at = at[~first], at[first]
            else:
                # Of pairs that overlap, every second one counts, from the left.
                joined = np.append(False, nxt[at[:-1]] == at[1:])
                starts = np.maximum.accumulate(np.where(joined, 0, np.arange(len(at))))
                later, at = at[:0], at[(np.arange(len(at)) - starts) % 2 == 0]
            eaten = nxt[at]
            after = nxt[eaten]
            tok[at] = r
            nxt[at] = after
            prv[after] = at
            rank[eaten] = NONE
            alive[eaten] = False
            before = prv[at]
            touched = _distinct(np.concatenate([at, before[before < n]]))
            right = nxt[touched]
            rank[touched] = np.where(right < n, self.pair_rank(tok[touched], tok[right]), NONE)
            post(np.concatenate([touched, later]))
        ids = tok[:n][alive].astype(np.uint32)
        return np.split(ids, np.cumsum(np.add.reduceat(alive, np.append(0, ends[:-1]), dtype=np.int64))[:-1])


class Encoder:
    """Whole texts to ids and back; holds a bounded table of encoded words."""

    def __init__(self, ranks_file: bytes, pattern: str):
        self.replay = MergeReplay({base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines()) if a})
        self.find, self.known = regex.compile(pattern).findall, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        words = [self.find(t) for t in texts]
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        new = [w for w in set().union(*words) if w not in self.known]
        ids = self.replay.encode([w.encode("utf-8") for w in new])
        self.known.update(zip(new, (x.astype("<u4").tobytes() for x in ids), strict=True))
        return [b"".join(map(self.known.__getitem__, w)) for w in words]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.replay.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=1)
def encoder_of(ranks_file: bytes, pattern: str) -> Encoder:
    """A Python worker serves several tasks; they share its vocabulary and words."""
    return Encoder(ranks_file, pattern)


def slices(texts: Iterable[str | None], most: int = SLICE_CHARS) -> Iterator[list[str]]:
    """Consecutive texts (null: empty) of about ``most`` characters together."""
    part, chars = [], 0
    for t in texts:
        part.append(t or "")
        chars += len(t or "")
        if chars >= most:
            yield part
            part, chars = [], 0
    if part:
        yield part


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text with the ranks of a tiktoken file, and decode the ids.

    Returns doc_id, ids (little-endian unsigned 32-bit integers), n_tokens,
    ids_sha256 and decoded_sha256 (of the decoded bytes), one row for each row
    of ``docs``.  A null or empty text has no ids; repeated rows and null ids
    are rows like others; an empty table gives an empty result.  Other columns
    are not read.
    """
    with open(ranks_path, "rb") as f:
        ranks_file = f.read()
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(ranks_file, pattern)
        for batch in batches:
            done = 0
            for texts in slices(batch.column("text").to_pylist()):
                ids = encoder.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(done, len(texts)),
                        pa.array(ids, pa.binary()),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                        pa.array([hashlib.sha256(encoder.decode(x)).hexdigest() for x in ids]),
                    ],
                    ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
                done += len(texts)

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind.simpleString()}, ids binary, n_tokens long, ids_sha256 string, decoded_sha256 string")
