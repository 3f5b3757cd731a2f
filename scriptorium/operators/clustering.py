"""Vectors, clustering and cluster evaluation on Spark ML (M01, M04-M10, M12, M13,
M18, M20, M22, M24, A47).

Vectors live in rows keyed by id (``jd_id, features array<float>``), never by
position.  k-means is one Lloyd pass for all settings and restarts at once;
the exact silhouette comes from distance blocks, the squared form of
``ClusteringEvaluator`` in linear time goes under its own name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import IDF, PCA, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from scriptorium.functions.arrays import let
from scriptorium.operators.density import silhouettes
from scriptorium.operators.neighbours import Cells, indexed, matrix
from scriptorium.session import written

SEED = 42
RESTARTS = 10
# Points that starts are drawn from, passes a run may take, and the move (share of the variance) that ends it.
START_ROWS, MOST_PASSES, TOLERANCE = 2000, 300, 1e-4
K_RANGE = [5, 10, 15, 20, 25, 30, 35, 40, 45, 50]


def embed_text(df: DataFrame, text_col: str = "jd_text", id_field: str = "jd_id", num_features: int = 1 << 12, sparse: bool = False) -> DataFrame:
    """M01 (re-aimed): TF-IDF vectors with unit norm; blank text -> zero vector.  ``sparse``: as the struct (size, at, x) of their entries.

    IDF needs one pass over the corpus for document frequencies (a reduce of
    one sparse vector per partition); the rest is a map.
    """
    tok = RegexTokenizer(inputCol="_t", outputCol="_w", pattern="\\W+", minTokenLength=1)
    base = df.select(F.col(id_field), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    words = tok.transform(base)
    tf = HashingTF(inputCol="_w", outputCol="_tf", numFeatures=num_features).transform(words)
    idf = IDF(inputCol="_tf", outputCol="_idf").fit(tf).transform(tf)
    norm = Normalizer(inputCol="_idf", outputCol="_v", p=2.0).transform(idf)
    if not sparse:
        return norm.select(id_field, vector_to_array("_v", "float32").alias("features"))
    v = F.unwrap_udt("_v")
    at = F.coalesce(v["indices"], F.sequence(F.lit(0), F.size(v["values"]) - 1))
    return norm.select(id_field, F.struct(F.lit(num_features).alias("size"), at.alias("at"), v["values"].cast("array<float>").alias("x")).alias("features"))


def embed_with(df: DataFrame, make_embedder: Callable[[], Callable[[np.ndarray], np.ndarray]], dims: int, text_col: str = "jd_text", id_field: str = "jd_id", batch_size: int = 100) -> DataFrame:
    """(id, features) by a model of the caller's.

    ``make_embedder`` runs once in each Python worker and gives a function from
    an array of texts to a matrix of ``dims`` columns; it sees at most
    ``batch_size`` texts at a time and never a null or blank one, whose vector
    is zero.  The model is loaded by the task, so only its factory is shipped.
    """

    def loaded() -> Callable[[np.ndarray], np.ndarray]:
        embed = make_embedder()

        def predict(texts: np.ndarray) -> np.ndarray:
            out = np.zeros((len(texts), dims), np.float32)
            some = np.array([bool(t.strip()) for t in texts], bool)
            if some.any():
                out[some] = embed(texts[some])
            return out

        return predict

    embedder = predict_batch_udf(loaded, return_type=ArrayType(FloatType()), batch_size=batch_size)
    return df.select(id_field, embedder(F.coalesce(F.col(text_col), F.lit(""))).alias("features"))


def l2_normalize(vec: Column) -> Column:
    """Unit L2 norm; a zero vector is left as is."""
    # the norm is bound once: inside the element lambda it would be recomputed per element
    return _scaled(vec, lambda x: x)


def _scaled(vec: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of every element of the vector with unit norm, in one pass."""
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return let(F.when(norm > 0, norm).otherwise(F.lit(1.0)), lambda n: F.transform(vec, lambda x: fn(x.cast("double") / n)))


def onehot(df: DataFrame, field: str, id_field: str = "jd_id", max_values: int = 10000) -> DataFrame:
    """0/1 block over the sorted distinct values of a field; NULL -> all 0.

    The value list is one small aggregate (checked against ``max_values``);
    each row's block is built by position without a join.
    """
    return df.select(id_field, onehot_block(F.col(field), onehot_values(df, field, max_values)).alias("onehot"))


def onehot_values(df: DataFrame, field: str, max_values: int = 10000) -> list[str]:
    """The sorted distinct values of a field."""
    vals = df.where(F.col(field).isNotNull()).select(F.array_sort(F.collect_set(F.col(field).cast("string")))).first()[0] or []
    if len(vals) > max_values:
        raise ValueError(f"{field} has {len(vals)} values; above the one-hot bound {max_values}")
    return vals


def onehot_block(value: Column, vals: list[str]) -> Column:
    arr = F.array(*[F.lit(v) for v in vals]) if vals else F.array().cast("array<string>")
    x = value.cast("string")
    return F.transform(arr, lambda v: F.when(x == v, F.lit(1.0)).otherwise(F.lit(0.0)))


def weighted_concat(text_vec: Column, hot: Column, w: float) -> Column:
    """W * normalised text vector ++ (1 - w) * one-hot block."""
    return F.concat(_scaled(text_vec, lambda x: x * w), F.transform(hot, lambda x: x * (1 - w)))


def _vectors(df: DataFrame, features: str = "features") -> DataFrame:
    return df.withColumn("_fv", array_to_vector(F.col(features)))


class _Dense:
    """Rows of a matrix."""

    def __init__(self, batch: pa.RecordBatch | pa.Table):
        column = batch.column("x")
        self.x = matrix(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)
        self.squares = (self.x * self.x).sum(axis=1)

    def matrix(self) -> np.ndarray:
        return self.x

    def dot(self, centres: np.ndarray) -> np.ndarray:
        return self.x @ centres.T

    def sums(self, at: np.ndarray, k: int) -> np.ndarray:
        hot = np.zeros((k, len(self.x)))
        hot[at, np.arange(len(self.x))] = 1.0
        return hot @ self.x


class _Sparse:
    """Rows by their entries (at, x); the work grows with the entries."""

    def __init__(self, batch: pa.RecordBatch | pa.Table, size: int):
        at, x = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (batch.column("at"), batch.column("x"))]
        self.at, self.x, self.n, self.size = at.flatten().to_numpy().astype(np.int64), x.flatten().to_numpy(), len(x), size
        self.row = np.repeat(np.arange(self.n), x.value_lengths().to_numpy())
        self.squares = np.bincount(self.row, self.x * self.x, self.n)

    def matrix(self) -> np.ndarray:
        out = np.zeros((self.n, self.size))
        out[self.row, self.at] = self.x
        return out

    def dot(self, centres: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.row, self.x * c[self.at], self.n) for c in centres], 1)

    def sums(self, at: np.ndarray, k: int) -> np.ndarray:
        return np.bincount(at[self.row] * self.size + self.at, self.x, k * self.size).reshape(k, self.size)


def _rows(batch: pa.RecordBatch | pa.Table, size: int | None) -> _Dense | _Sparse:
    return _Dense(batch) if size is None else _Sparse(batch, size)


def _first_centres(points: DataFrame, runs: list[tuple[int, int]], seed: int, size: int | None = None) -> dict[tuple[int, int], np.ndarray]:
    """k-means++ starts of every (k, restart) on at most ``START_ROWS`` points chosen by hash; the passes read all points."""
    rows = points.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(START_ROWS).drop("id").toArrow()
    x = _rows(rows, size).matrix()
    starts = {}
    for k, r in runs:
        rng = np.random.default_rng([seed, k, r])
        chosen = [int(rng.integers(len(x)))]
        near = ((x - x[chosen[0]]) ** 2).sum(axis=1)
        for _ in range(min(k, len(x)) - 1):
            total = near.sum()
            chosen.append(int(rng.choice(len(x), p=near / total)) if total > 0 else int(rng.integers(len(x))))
            near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
        starts[k, r] = x[chosen]
    return starts


def _nearest_centres(rows: _Dense | _Sparse, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = rows.squares[:, None] - 2 * rows.dot(centres) + (centres * centres).sum(axis=1)[None, :]
    at = d.argmin(axis=1)
    return at, np.maximum(d[np.arange(len(d)), at], 0.0)


def lloyd(points: DataFrame, runs: list[tuple[int, int]], seed: int = SEED, most: int = MOST_PASSES, size: int | None = None) -> dict[tuple[int, int], tuple[np.ndarray, float]]:
    """Centres and cost of every run (k, restart), with one scan of ``points`` (id, x; with ``size``: id, at, x) a pass for all of them.

    A pass sums each partition by (run, cluster) inside the task; the partial
    sums are added by run and only centres reach the driver.  A run
    stops when its centres move less than ``TOLERANCE`` of the variance.
    """
    centres = _first_centres(points, runs, seed, size)
    costs, active = {}, list(runs)
    schema = "run int, sums binary"

    def one_pass(asked: list[tuple[int, int]]) -> dict[int, np.ndarray]:
        given = [centres[r] for r in asked]

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept: dict[int, np.ndarray] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                rows = _rows(batch, size)
                none = np.zeros(batch.num_rows, np.int64)
                for i, c in [(-1, None), *enumerate(given)]:
                    at, cost = (none, rows.squares) if c is None else _nearest_centres(rows, c)
                    k = 1 if c is None else len(c)
                    sums = np.column_stack([np.bincount(at, minlength=k), np.bincount(at, cost, k), rows.sums(at, k)])
                    kept[i] = kept[i] + sums if i in kept else sums
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.int32()), pa.array([x.tobytes() for x in kept.values()], pa.binary())], names=["run", "sums"])

        def sum_up(rows: pa.Table) -> pa.Table:
            """The sums of one run: a row for each task that sent some."""
            total = sum(np.frombuffer(x.as_buffer()) for x in rows.column("sums"))
            return pa.table({"run": rows.column("run")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

        sums = points.drop("id").mapInArrow(add, schema).groupBy("run").applyInArrow(sum_up, schema).toArrow()
        # A row of a run's sums is a cluster: its points, their cost and their total.
        return {run.as_py(): np.frombuffer(x.as_buffer()).reshape(1 if run.as_py() < 0 else len(given[run.as_py()]), -1) for run, x in zip(sums.column("run"), sums.column("sums"), strict=True)}

    for number in range(most + 1):
        found = one_pass(active)
        n, cost, total = found[-1][0, 0], found[-1][0, 1], found[-1][0, 2:]
        mean = total / n
        variance = max(cost / n - float(mean @ mean), 0.0) / max(len(mean), 1)
        going = []
        for i, run in enumerate(active):
            sums = found[i]
            costs[run] = float(sums[:, 1].sum())
            some = sums[:, 0] > 0
            new = centres[run].copy()
            new[some] = sums[some, 2:] / sums[some, :1]
            # The cost belongs to the centres of the pass; they stay when they no longer move.
            if ((new - centres[run]) ** 2).sum() > TOLERANCE * variance and number < most:
                centres[run] = new
                going.append(run)
        active = going
        if not active:
            break
    return {run: (centres[run], costs[run]) for run in runs}


def kmeans_many(df: DataFrame, ks: list[int], seed: int = SEED, restarts: int = RESTARTS, features: str = "features", id_field: str = "jd_id", most: int = MOST_PASSES):
    """M09 for several k at once: the best of ``restarts`` runs of each k, of at most ``most`` passes.

    Returns (assignments (k, id, cluster), centres (k, cluster, center), costs
    {k: cost}).  A k above the number of points is taken as that number.  The
    vectors are written once under the shared folder, dealt evenly so that every
    core has a part however few files they came in, and scanned once a pass for all runs; rows without a vector take no part.
    Vectors may be given by their entries, as ``embed_text(sparse=True)`` does.
    """
    sparse = df.schema[features].dataType.typeName() == "struct"
    columns = [F.col(features)["at"].alias("at"), F.col(features)["x"].cast("array<double>").alias("x")] if sparse else [F.col(features).cast("array<double>").alias("x")]
    vectors = df.where(F.col(features).isNotNull())
    points = written(vectors.select(F.col(id_field).alias("id"), *columns).repartition(2 * df.sparkSession.sparkContext.defaultParallelism), "kmeans")
    size = (vectors.select(F.col(features)["size"]).first() or [0])[0] if sparse else None
    spark = df.sparkSession
    key = df.schema[id_field].dataType.simpleString()
    if not points.head(1):
        return spark.createDataFrame([], f"k int, {id_field} {key}, cluster int"), spark.createDataFrame([], "k int, cluster int, center array<double>"), {}
    runs = lloyd(points, [(k, r) for k in ks for r in range(restarts)], seed, most, size)
    best = {k: min(((cost, r, c) for (j, r), (c, cost) in runs.items() if j == k), key=lambda v: v[:2]) for k in ks}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = _rows(batch, size)
                for k, (_, _, c) in best.items():
                    at, _ = _nearest_centres(rows, c)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), batch.column("id"), pa.array(at.astype(np.int32))], names=["k", id_field, "cluster"])

    assignments = points.mapInArrow(assign, f"k int, `{id_field}` {key}, cluster int")
    centres = spark.createDataFrame([(k, i, [float(v) for v in row]) for k, (_, _, c) in best.items() for i, row in enumerate(c)], "k int, cluster int, center array<double>")
    return assignments, centres, {k: float(b[0]) for k, b in best.items()}


def kmeans(df: DataFrame, k: int = 10, seed: int = SEED, restarts: int = RESTARTS, features: str = "features", id_field: str = "jd_id", most: int = MOST_PASSES):
    """(assignments (id, cluster), centres (cluster, center), cost) of the best of ``restarts`` runs."""
    assignments, centres, costs = kmeans_many(df, [k], seed, restarts, features, id_field, most)
    return assignments.drop("k"), centres.drop("k"), costs.get(k, 0.0)


def bisecting(df: DataFrame, k: int = 10, seed: int = SEED, features: str = "features", id_field: str = "jd_id") -> DataFrame:
    """Divisive k-means with Ward's variance objective, beside the agglomeration of M10 (``ward``)."""
    v = _vectors(df.select(id_field, features), features)
    m = BisectingKMeans(k=k, seed=seed, featuresCol="_fv", predictionCol="cluster").fit(v)
    return m.transform(v).select(id_field, F.col("cluster").cast("int").alias("cluster"))


def silhouette_sq(df: DataFrame, assign: DataFrame, features: str = "features", id_field: str = "jd_id") -> float:
    """M13 at scale: squared-Euclidean silhouette (ClusteringEvaluator, linear time)."""
    j = _vectors(df.select(id_field, features).join(assign, id_field), features).withColumn("cluster", F.col("cluster").cast("double"))
    ev = ClusteringEvaluator(featuresCol="_fv", predictionCol="cluster", metricName="silhouette", distanceMeasure="squaredEuclidean")
    return ev.evaluate(j)


def silhouettes_sq(df: DataFrame, centres: DataFrame, features: str = "features", id_field: str = "jd_id") -> dict[int, float]:
    """``silhouette_sq`` for each k of ``centres`` (k, cluster, center) of the rows with an id, each in the cluster of its nearest centre.

    The rows are those of ``kmeans_many``, ids without repeats.  Two scans for all
    k, no join: numbers, sums and squares by cluster, then every row's distances to them.
    """
    given: dict[int, np.ndarray] = {}
    for r in centres.orderBy("k", "cluster").collect():
        given.setdefault(r["k"], []).append(r["center"])
    given = {k: np.array(c) for k, c in given.items()}
    points = df.where(F.col(features).isNotNull() & F.col(id_field).isNotNull()).select(F.col(features).cast("array<double>").alias("x"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                rows = _Dense(batch)
                for k, c in given.items():
                    at, _ = _nearest_centres(rows, c)
                    sums = np.column_stack([np.bincount(at, minlength=len(c)), np.bincount(at, rows.squares, len(c)), rows.sums(at, len(c))])
                    kept[k] = kept[k] + sums if k in kept else sums
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.int32()), pa.array([x.tobytes() for x in kept.values()], pa.binary())], names=["k", "sums"])

    def sum_up(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer()) for x in rows.column("sums"))
        return pa.table({"k": rows.column("k")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    found = points.mapInArrow(add, "k int, sums binary").groupBy("k").applyInArrow(sum_up, "k int, sums binary").toArrow()
    stats = {k.as_py(): np.frombuffer(x.as_buffer()).reshape(len(given[k.as_py()]), -1) for k, x in zip(found.column("k"), found.column("sums"), strict=True)}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = dict.fromkeys(stats, 0.0)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _Dense(batch)
            for k, s in stats.items():
                at, _ = _nearest_centres(rows, given[k])
                n = np.where(s[:, 0] > 0, s[:, 0], np.inf)
                mean = np.maximum(rows.squares[:, None] + (s[:, 1] / n)[None, :] - 2 * (rows.x @ s[:, 2:].T) / n, 0.0)
                mean[:, s[:, 0] == 0] = np.inf
                here = np.arange(len(at))
                own = mean[here, at] * s[at, 0] / np.maximum(s[at, 0] - 1, 1)
                mean[here, at] = np.inf
                other = mean.min(axis=1)
                most = np.maximum(own, other)
                total[k] += float(np.where((own == other) | (s[at, 0] == 1), 0.0, (other - own) / np.where(most > 0, most, 1.0)).sum())
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.float64())], names=["k", "score"])

    sums = points.mapInArrow(score, "k int, score double").groupBy("k").agg(F.sum("score").alias("score")).collect()
    for k, s in stats.items():
        if (s[:, 0] > 0).sum() < 2:
            raise ValueError(f"k {k}: the silhouette needs two clusters")
    return {r["k"]: r["score"] / float(stats[r["k"]][:, 0].sum()) for r in sums}


def find_optimal_k(df: DataFrame, k_values=K_RANGE, restarts: int = RESTARTS, features: str = "features", id_field: str = "jd_id") -> DataFrame:
    """(k, silhouette, silhouette_sq, cost, best) per k (k >= n skipped); best marks the largest exact silhouette, ties to the smaller k."""
    points = indexed(df, id_field, features)
    n = points.count()
    ks = [k for k in k_values if k < n]
    assignments, _, costs = kmeans_many(df, ks, restarts=restarts, features=features, id_field=id_field)
    labels = written(points.select("p", F.col("id").alias(id_field)).join(assignments, id_field), "optimal-k")
    scores = silhouettes(Cells(points), labels.select("k", "p", "cluster"), ["k"])
    cost = F.coalesce(*[F.when(F.col("k") == k, F.lit(c)) for k, c in costs.items()], F.lit(None).cast("double"))
    # One row for each k.
    rank = F.row_number().over(Window.orderBy(F.desc_nulls_last("silhouette"), "k"))
    return scores.select("k", "silhouette", "silhouette_sq", cost.alias("cost"), (rank == 1).alias("best"))


def project_2d(df: DataFrame, k: int = 2, features: str = "features", id_field: str = "jd_id") -> DataFrame:
    """M20 (re-aimed UMAP/t-SNE): PCA to k coordinates, sign fixed so the
    largest loading of each component is positive."""
    v = _vectors(df.select(id_field, features), features)
    m = PCA(k=k, inputCol="_fv", outputCol="_p").fit(v)
    pc = m.pc.toArray()
    signs = [1.0 if pc[abs(pc[:, j]).argmax(), j] >= 0 else -1.0 for j in range(k)]
    out = m.transform(v).select(id_field, vector_to_array("_p").alias("_p"))
    names = ["x", "y", "z"][:k]
    return out.select(id_field, *[(F.col("_p")[j] * signs[j]).alias(names[j]) for j in range(k)])


def feature_stats(df: DataFrame, features: str = "features") -> DataFrame:
    """A47 + M24: shape, mean/std(pop)/min/max over all values, zero vectors
    (norm < 1e-6), mean L2 norm, NaN/Inf vectors."""
    norm = F.sqrt(F.aggregate(F.col(features), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    bad = F.exists(F.col(features), lambda x: F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    rows = df.select(norm.alias("_n"), bad.alias("_bad"), F.size(features).alias("_d"))
    vals = df.select(F.explode(features).alias("_x")).agg(
        F.avg(F.col("_x").cast("double")).alias("mean"),
        F.stddev_pop(F.col("_x").cast("double")).alias("std"),
        F.min(F.col("_x").cast("double")).alias("min"),
        F.max(F.col("_x").cast("double")).alias("max"),
    )
    r = rows.agg(
        F.count(F.lit(1)).cast("bigint").alias("n_rows"),
        F.max("_d").cast("bigint").alias("dims"),
        F.count_if(F.col("_n") < 1e-6).cast("bigint").alias("zero_vectors"),
        F.avg("_n").alias("mean_norm"),
        F.count_if("_bad").cast("bigint").alias("nan_inf_vectors"),
    )
    return r.select(
        "*",
        vals.select(F.first("mean")).scalar().alias("mean"),
        vals.select(F.first("std")).scalar().alias("std"),
        vals.select(F.first("min")).scalar().alias("min"),
        vals.select(F.first("max")).scalar().alias("max"),
    )
