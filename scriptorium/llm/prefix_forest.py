"""Nearest neighbours by inner product with a hash-prefix forest.

Vectors are cut into shards of bounded size.  In each shard every tree holds
the vectors' hash strings (signs of random projections) as one sorted array.  A
query goes down every tree to its longest matching prefix, and then up in all
trees at once, one bit at a time, until the vectors under the common prefixes
of that length are enough candidates; they are compared exactly.  The shards'
best are merged, so no task holds more than a shard and a block of queries.

Inner product becomes an angle by one more dimension, which brings all vectors
to the largest norm.  Equal vectors are indexed once with as many of their ids
as any query could return, hence a hot vector costs no more than another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import staged

TREES, BITS, SEED = 64, 32, 20
SHARD_ROWS, QUERY_ROWS = 8192, 1024
# The share of a shard to compare at least: sets the recall.
SHARE = 0.45


class Forest:
    """The trees of one shard: hash strings in order, and the rows they belong to."""

    def __init__(self, vectors: np.ndarray, norm: float, seed: int = SEED):
        n, width = vectors.shape
        self.vectors, self.norm = vectors, norm
        self.planes = np.random.default_rng(seed).standard_normal((width + 1, TREES * BITS)).astype(np.float32)
        rest = np.sqrt(np.maximum(norm * norm - np.einsum("ij,ij->i", vectors, vectors), 0))
        codes = self._hash(np.column_stack([vectors, rest]))
        self.rows = np.argsort(codes, axis=1, kind="stable")
        self.codes = np.take_along_axis(codes, self.rows, axis=1)

    def _hash(self, points: np.ndarray) -> np.ndarray:
        """Hash strings by tree and point."""
        out = np.empty((TREES, len(points)), np.uint32)
        for t in range(TREES):
            bits = points.astype(np.float32) @ self.planes[:, t * BITS : (t + 1) * BITS] > 0
            out[t] = np.packbits(bits, axis=1).view(">u4")[:, 0]
        return out

    def ranges(self, codes: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """In every tree, where the strings with a query's first ``length`` bits begin and end."""
        low = np.where(length == 0, 0, (0xFFFFFFFF << (BITS - length)) & 0xFFFFFFFF).astype(np.uint32)
        first, last = codes & low, codes | ~low
        begin, end = np.empty(codes.shape, np.int64), np.empty(codes.shape, np.int64)
        for t in range(TREES):
            begin[t], end[t] = np.searchsorted(self.codes[t], first[t], "left"), np.searchsorted(self.codes[t], last[t], "right")
        return begin, end

    def search(self, queries: np.ndarray, least: int) -> Iterator[np.ndarray]:
        """For each query the candidate rows: those under the longest common prefix length that has ``least``."""
        codes = self._hash(np.column_stack([queries, np.zeros(len(queries))]))
        length = np.full(len(queries), BITS)
        open_ = np.ones(len(queries), bool)
        for bits in range(BITS, -1, -1):
            # Up by one bit in all trees together, for the queries that want more.
            length[open_] = bits
            begin, end = self.ranges(codes[:, open_], length[open_])
            enough = np.array([self._reaches(b, e, least) for b, e in zip(begin.T, end.T, strict=True)])
            open_[np.flatnonzero(open_)[enough]] = False
            if not open_.any():
                break
        begin, end = self.ranges(codes, length)
        for q in range(len(queries)):
            yield np.flatnonzero(self._under(begin[:, q], end[:, q]))

    def _under(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        seen = np.zeros(self.rows.shape[1], bool)
        for t, (b, e) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)):
            seen[self.rows[t, b:e]] = True
        return seen

    def _reaches(self, begin: np.ndarray, end: np.ndarray, least: int) -> bool:
        return int((end - begin).sum()) >= least and int(self._under(begin, end).sum()) >= min(least, self.rows.shape[1])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", share: float = SHARE) -> DataFrame:
    """The ``k`` rows of ``vectors`` of largest inner product with each query.

    ``queries`` has the same two columns; a row is no candidate for a query of
    its own id.  Returns query_id, rank (from 1), vec_id, score (double
    precision, on the original vectors), ties to the smaller id, all candidates
    if fewer than ``k``.  Vectors that are null, zero, or hold nulls or numbers
    that are not finite take no part, nor do null ids; of rows that repeat an id
    with one vector one counts.  Vectors of another length than a query's never
    meet it.  Other columns are not read.
    """

    def usable(df: DataFrame) -> DataFrame:
        df = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
        fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
        return df.filter(F.col("id").isNotNull() & fine)

    # -0.0 and 0.0 are one value, and so one vector.
    points = usable(vectors).withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
    points = points.withColumn("key", F.unhex(F.md5(F.to_json("vector").cast("binary"))))
    smallest = Window.partitionBy("key").orderBy("id")
    points = points.dropDuplicates(["key", "id"]).withColumn("copy", F.row_number().over(smallest)).filter(F.col("copy") <= k + 1)
    distinct = points.groupBy("key").agg(F.first("vector").alias("vector"), F.sort_array(F.collect_list("id")).alias("ids"))
    distinct = staged(distinct.withColumn("width", F.size("vector")), "forest-points")
    norm2 = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    sizes = {r["width"]: (r["n"], float(r["norm"]) ** 0.5) for r in distinct.groupBy("width").agg(F.count("*").alias("n"), F.max(norm2).alias("norm")).collect()}
    table = [(w, -(-n // SHARD_ROWS), norm) for w, (n, norm) in sizes.items()]
    shards = distinct.sparkSession.createDataFrame(table, "width int, shards long, norm double")

    place = F.pmod(F.xxhash64("key"), F.col("shards"))
    cells = distinct.join(F.broadcast(shards), "width").select("width", place.alias("shard"), "norm", "vector", "ids")
    asked = usable(queries).dropDuplicates(["id"]).withColumn("width", F.size("vector"))
    # Blocks of the query set against every shard.
    asked = asked.join(F.broadcast(shards), "width").select("width", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"), "id", "vector")

    def best(key, points: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(points) and len(asked):
            rows = np.array(points["vector"].tolist(), np.float64)
            ids = points["ids"].tolist()
            forest = Forest(rows, float(points["norm"].iloc[0]))
            least = max(4 * k, int(share * len(rows)))
            for start in range(0, len(asked), QUERY_ROWS):
                block = asked.iloc[start : start + QUERY_ROWS]
                matrix = np.array(block["vector"].tolist(), np.float64)
                for query, q, found in zip(block["id"].tolist(), matrix, forest.search(matrix, least), strict=True):
                    score = rows[found] @ q
                    if len(found) > k + 1:
                        # All that tie with the last one stay until ids decide.
                        limit = np.partition(score, -(k + 1))[-(k + 1)]
                        keep = score >= limit - 1e-9 * max(1.0, abs(limit))
                        found, score = found[keep], score[keep]
                    pairs = [(query, v, float(np.dot(rows[f], q))) for f in found.tolist() for v in ids[f] if v != query]
                    parts += sorted(pairs, key=lambda p: (-p[2], p[1]))[:k]
        return pd.DataFrame(parts, columns=["query_id", "vec_id", "score"])

    found = cells.groupBy("width", "shard").cogroup(asked.groupBy("width", "shard")).applyInPandas(best, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
