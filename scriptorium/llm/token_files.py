"""Token ids as flat binary files with document offsets, read through memory maps.

Documents are dealt out by ranges of their id, so that partition k's documents
come before partition k+1's.  Each partition writes three flat files into the
shared folder: the ids as unsigned 16- or 32-bit integers, one 64-bit offset
for each document plus the end, and the document ids.  A manifest has a row for
each partition; the prefix sums of its token counts are the partitions' bases.

A file is written under the attempt's own name and then renamed, so a repeated
or speculative task leaves the same files and a lost executor costs only its
tasks.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.bpe import slices
from scriptorium.llm.common import shared_path, staged

KEPT_WORDS = 600_000
# Chunks of so many characters are in memory at one time.
SLICE_CHARS = 1_000_000
# New chunks go to the library joined by this mark, which becomes one token of
# its own; chunks that hold it go alone.
MARK, JOINED = "|", 256
# Python takes these for white space, the tokenizer's pattern does not.
ODD_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")
MANIFEST = "part long, ids string, offsets string, docs string, n_docs long, n_tokens long"


class WordEncoder:
    """Ids of whole texts by a tokenizer whose pre-tokens never span white space.

    Each distinct white-space-delimited chunk is encoded once by the library.
    """

    def __init__(self, tokenizer_json: str, dtype: str):
        # Spark's tasks share the cores: no thread pool in each of them.  The library reads this at its first batch.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype, self.known = Tokenizer.from_str(tokenizer_json), dtype, {}
        (self.mark,) = self.tokenizer.encode(MARK, add_special_tokens=False).ids

    def _library(self, texts: list[str]) -> Iterator[np.ndarray]:
        for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            yield np.array(e.ids, self.dtype)

    def _learn(self, chunks: list[str]) -> None:
        alone = [c for c in chunks if MARK in c]
        self.known.update(zip(alone, (x.tobytes() for x in self._library(alone)), strict=True))
        rest = [c for c in chunks if MARK not in c]
        groups = [rest[i : i + JOINED] for i in range(0, len(rest), JOINED)]
        for group, ids in zip(groups, self._library([f" {MARK} ".join(g) for g in groups]), strict=True):
            flat, width = ids.tobytes(), ids.itemsize
            ends = [*(np.flatnonzero(ids == self.mark) * width).tolist(), len(flat)]
            starts = [0, *(e + width for e in ends[:-1])]
            self.known.update((c, flat[a:b]) for c, a, b in zip(group, starts, ends, strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        odd = [any(c in t for c in ODD_SPACE) for t in texts]
        chunks = [[] if o else t.split() for t, o in zip(texts, odd, strict=True)]
        self._learn([c for c in set().union(*chunks) if c not in self.known])
        ids = [b"".join(map(self.known.__getitem__, c)) for c in chunks]
        whole = self._library([t for t, o in zip(texts, odd, strict=True) if o])
        return [next(whole).tobytes() if o else x for x, o in zip(ids, odd, strict=True)]


@lru_cache(maxsize=1)
def encoder_of(tokenizer_json: str, dtype: str) -> WordEncoder:
    """One encoder and table of chunks for the tasks of a Python worker."""
    return WordEncoder(tokenizer_json, dtype)


def _file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _mapped(uri: str, dtype: str) -> np.ndarray:
    """The file as an array: mapped if it is a local file, else read."""
    fs, path = _file_system(uri)
    if isinstance(fs, pyarrow.fs.LocalFileSystem):
        return np.memmap(path, dtype, "r") if fs.get_file_info(path).size else np.empty(0, dtype)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, append ``end_id`` and write the files in ascending id order.

    Returns the manifest (part, file paths, n_docs, n_tokens, id_bytes, base).
    Ids are integers; null ids come first; rows with equal ids follow in the
    order of their texts' hash; a null text is empty.  An empty table gives an
    empty manifest.  Other columns are not read.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()
    from tokenizers import Tokenizer

    id_bytes = 2 if Tokenizer.from_str(tokenizer_json).get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
    dtype = f"<u{id_bytes}"
    folder = shared_path(docs.sparkSession, "token-files")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, own = task.partitionId(), f".{task.taskAttemptId()}"
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        fs, root = _file_system(folder)
        fs.create_dir(root, recursive=True)
        names = [f"part-{part:06d}.{x}" for x in ("ids", "offsets", "docs")]
        end, at, n_docs = np.array([end_id], dtype).tobytes(), 0, 0
        encoder = encoder_of(tokenizer_json, dtype)
        ids_out, offsets_out, docs_out = (fs.open_output_stream(f"{root}/{n}{own}") for n in names)
        with ids_out, offsets_out, docs_out:
            offsets_out.write(np.array([0], "<u8").tobytes())
            for batch in (b for group in ([first], batches) for b in group):
                keys = batch.column("doc_id")
                # Each document's id and whether it has one.
                table = np.empty((len(keys), 2), "<i8")
                table[:, 0], table[:, 1] = keys.fill_null(0).to_numpy(), keys.is_valid().to_numpy(zero_copy_only=False)
                docs_out.write(table.tobytes())
                n_docs += len(keys)
                for texts in slices((t.as_py() for t in batch.column("text")), SLICE_CHARS):
                    ids = [x + end for x in encoder.encode(texts)]
                    ids_out.write(b"".join(ids))
                    upto = at + np.cumsum([len(x) // id_bytes for x in ids], dtype="<u8")
                    offsets_out.write(upto.astype("<u8").tobytes())
                    at = int(upto[-1])
        for n in names:
            fs.move(f"{root}/{n}{own}", f"{root}/{n}")
        yield pa.RecordBatch.from_pydict({"part": [part], **dict(zip(("ids", "offsets", "docs"), ([f"{folder}/{n}"] for n in names), strict=True)), "n_docs": [n_docs], "n_tokens": [at]})

    order = ["doc_id", "tie"]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    parts = staged(rows.mapInArrow(run, MANIFEST), "token-manifest")
    # One row for each partition: their number bounds what is summed here.
    bases, base = [], 0
    for r in parts.select("part", "n_tokens").sort("part").collect():
        bases.append((r["part"], base))
        base += r["n_tokens"]
    table = docs.sparkSession.createDataFrame(bases, "part long, base long")
    return parts.join(table, "part").withColumn("id_bytes", F.lit(id_bytes))


def read_token_files(spark: SparkSession, manifest: DataFrame, batch_docs: int = 10_000) -> DataFrame:
    """Read the files back: doc_id, start, n_tokens, ids_crc32 (of unsigned 32-bit ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m in (m for batch in batches for m in batch.to_pylist()):
            ids, offsets = _mapped(m["ids"], f"<u{m['id_bytes']}"), _mapped(m["offsets"], "<u8").astype(np.int64)
            docs = _mapped(m["docs"], "<i8").reshape(-1, 2)
            for k in range(0, len(docs), batch_docs):
                part, at = docs[k : k + batch_docs], offsets[k : k + batch_docs + 1]
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[:, 0], mask=part[:, 1] == 0), pa.array(at[:-1] + m["base"]), pa.array(np.diff(at)), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    each = manifest.select("part", "ids", "offsets", "docs", "base", "id_bytes").repartition(max(1, manifest.count()), "part")
    return each.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
