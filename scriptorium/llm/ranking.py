"""Quality scores by Bradley-Terry pairwise ranking.

Every text has a vector of surface features (byte classes, words, repeats).  A
document wins over another with probability sigmoid(w * (x_i - x_j)); w comes
from pairs of a good and a bad labelled document by logistic loss on their
feature differences.  The cut between good and bad is a quantile of the labelled
documents' values: the share of bad labels.  The score is the sigmoid of a
document's distance from that cut, and ``cut_score`` at the cut.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import staged

# Labelled rows of either class the weights are fitted on, in hash order.
SAMPLE_ROWS, PAIRS_EACH, RIDGE = 10_000, 4, 1e-3
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def features(text: str | None) -> np.ndarray:
    """Features of a text; empty and null texts have the same."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(data))
    h = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words, lines = data.split(), data.split(b"\n")
    w = max(1, len(words))
    shares = [h[65:91].sum(), h[97:123].sum(), h[48:58].sum(), h[32], h[10], h[:9].sum() + h[11:32].sum(), h[128:].sum(), *h[list(MARKS)]]
    counts = [
        len(set(words)) / w,
        sum(a == b for a, b in pairwise(words)) / w,
        sum(x.isupper() for x in words) / w,
        sum(not x[-1:].isalnum() for x in words) / w,
        sum(len(x) == 1 for x in words) / w,
        len(set(lines)) / max(1, len(lines)),
    ]
    sizes = [math.log1p(len(data)), math.log1p(len(words)), math.log1p(n / w), math.log1p(w / max(1, len(lines)))]
    return np.concatenate([np.sqrt(np.array(shares, float) / n), np.sqrt(np.array(counts)), np.array(sizes)])


def fit(good: np.ndarray, bad: np.ndarray, seed: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, spread and weights: Newton steps of the logistic loss on differences good - bad."""
    every = np.concatenate([good, bad])
    mean, spread = every.mean(0), np.maximum(every.std(0), 1e-3)
    w = np.zeros(every.shape[1])
    if not len(good) or not len(bad):
        return mean, spread, w
    rng = np.random.default_rng(seed)
    i = np.resize(rng.permutation(len(good)), max(len(good), len(bad)) * PAIRS_EACH)
    j = np.concatenate([np.resize(rng.permutation(len(bad)), max(len(good), len(bad))) for _ in range(PAIRS_EACH)])
    x = np.clip((good[i] - mean) / spread, -6, 6) - np.clip((bad[j] - mean) / spread, -6, 6)
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - 1) / len(x) + RIDGE * w
        curve = (x * (p * (1 - p))[:, None]).T @ x / len(x) + RIDGE * np.eye(len(w))
        w -= np.linalg.solve(curve, slope)
    return mean, spread, w


def score_quality(docs: DataFrame, labels: DataFrame, held_out: Column, cut_score: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", row_col: str | None = None) -> DataFrame:
    """Score every row of ``docs``: doc_id, held_out, score (0 to 1), predicted (score >= cut_score).

    ``held_out``: a column of the ids ("doc_id") whose labels are not learned
    from.  Labels that are null or that name no document count for nothing; of
    several labels of an id the smallest counts.  Without labels of both classes
    every document scores alike.  Null and empty texts are scored like others,
    null ids are held out.  An empty table gives an empty result.  ``row_col``: a
    column to return too, as a key of the row.  Other columns are not read.
    """
    row = [row_col] if row_col else []

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*map(batch.column, keys), pa.array(rows, pa.list_(pa.float64()))], [*keys, "x"])

    rows = docs.select(*row, F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    keys = rows.columns[:-1]
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys)
    described = staged(rows.mapInArrow(describe, f"{kinds}, x array<double>"), "quality-features")
    described = described.withColumn("held_out", F.coalesce(held_out, F.lit(True)))

    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label")).filter("label IS NOT NULL").groupBy("doc_id").agg(F.min("label").alias("label"))
    learned = described.filter(~F.col("held_out")).join(marks, "doc_id")
    sample = {}
    for label in (0, 1):
        some = learned.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
        sample[label] = np.array([r["x"] for r in some.select("x").collect()], float).reshape(-1, len(features("")))
    mean, spread, weights = fit(sample[1], sample[0]) if len(sample[0]) + len(sample[1]) else (0.0, 1.0, np.zeros(len(features(""))))

    def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), float).reshape(-1, len(weights))
            u = np.clip((x - mean) / spread, -6, 6) @ weights
            yield pa.RecordBatch.from_arrays([*map(batch.column, [*keys, "held_out"]), pa.array(u, pa.float64())], [*keys, "held_out", "u"])

    valued = staged(described.select(*keys, "held_out", "x").mapInArrow(value, f"{kinds}, held_out boolean, u double"), "quality-values")
    known = valued.filter(~F.col("held_out")).join(marks, "doc_id")
    share = known.agg(F.avg((F.col("label") == 0).cast("double"))).first()[0] or 0.0
    # The middle of the quantiles around the share, as classes may lie apart there.
    low, high = known.agg(F.percentile_approx("u", [0.98 * share, share + 0.02 * (1 - share)], 100_000)).first()[0] or (0.0, 0.0)
    cut = (low + high) / 2
    distance = F.least(F.greatest(F.col("u") - cut, F.lit(-30.0)), F.lit(30.0)) + math.log(cut_score / (1 - cut_score))
    score = 1 / (1 + F.exp(-distance))
    out = valued.select(*keys, "held_out", score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= cut_score).cast("int"))
