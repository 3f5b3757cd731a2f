"""Checked queries: vectors, one-hot blocks, clustering (F6 vectors, F1/F3/F8 for features)."""

from __future__ import annotations

import uuid

import numpy as np

from pyspark.sql import functions as F

from scriptorium.functions.numeric import rnd

from scriptorium.operators import clustering as C
from scriptorium.operators import density as D
from scriptorium.operators import structure as S
from scriptorium.operators.neighbours import Cells, core_distances, indexed, nearest
from scriptorium.operators.ward import ward
from scriptorium.plans.registry import fx, query
from scriptorium.session import scratch_path, written

V = ("f_vectors",)


def _vec(spark, sf):
    return fx(spark, sf, "f_vectors")


_NORM = """n AS (SELECT jd_id, sqrt(list_sum(list_transform(features, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS nrm, features FROM f_vectors),
e AS (SELECT jd_id, i - 1 AS dim, CAST(features[i] AS DOUBLE) / CASE WHEN nrm > 0 THEN nrm ELSE 1.0 END AS value
      FROM (SELECT jd_id, nrm, features, unnest(range(1, len(features) + 1)) AS i FROM n))"""


@query("m05_l2_normalize", f"WITH {_NORM} SELECT jd_id, CAST(dim AS BIGINT) AS dim, round(value, 6) AS value FROM e", V)
def q_m05(spark, sf):
    v = _vec(spark, sf).select("jd_id", C.l2_normalize(F.col("features")).alias("u"))
    return v.select("jd_id", F.posexplode("u").alias("dim", "value")).select("jd_id", F.col("dim").cast("bigint"), rnd("value", 6).alias("value"))


@query(
    "m04_onehot",
    """WITH lv AS (SELECT list_sort(list(DISTINCT level)) AS vals FROM f_meta)
SELECT jd_id, array_to_string(list_transform(vals, lambda v: CASE WHEN level = v THEN 1 ELSE 0 END), ',') AS onehot FROM f_meta, lv""",
    ("f_meta",),
)
def q_m04(spark, sf):
    h = C.onehot(fx(spark, sf, "f_meta"), "level")
    return h.select("jd_id", F.array_join(F.transform("onehot", lambda x: x.cast("int").cast("string")), ",").alias("onehot"))


@query(
    "m06_weighted_concat",
    f"""WITH {_NORM},
lv AS (SELECT list_sort(list(DISTINCT CAST(label AS VARCHAR))) AS vals FROM f_vectors),
h AS (SELECT jd_id, 64 + i - 1 AS dim, CASE WHEN CAST(label AS VARCHAR) = vals[i] THEN 0.2 ELSE 0.0 END AS value
      FROM (SELECT jd_id, label, vals, unnest(range(1, len(vals) + 1)) AS i FROM f_vectors, lv))
SELECT jd_id, CAST(dim AS BIGINT) AS dim, round(value * 0.8, 6) AS value FROM e UNION ALL SELECT jd_id, CAST(dim AS BIGINT), round(value, 6) FROM h""",
    V,
)
def q_m06(spark, sf):
    v = _vec(spark, sf)
    h = C.onehot(v, "label")
    j = v.join(h, "jd_id").select("jd_id", C.weighted_concat(F.col("features"), F.col("onehot"), 0.8).alias("w"))
    return j.select("jd_id", F.posexplode("w").alias("dim", "value")).select("jd_id", F.col("dim").cast("bigint"), rnd("value", 6).alias("value"))


@query(
    "a47_feature_stats",
    """WITH r AS (SELECT features, sqrt(list_sum(list_transform(features, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS nrm FROM f_vectors),
x AS (SELECT CAST(unnest(features) AS DOUBLE) AS x FROM f_vectors)
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(max(len(features)) AS BIGINT) AS dims, CAST(count(*) FILTER (WHERE nrm < 1e-6) AS BIGINT) AS zero_vectors,
  avg(nrm) AS mean_norm, CAST(count(*) FILTER (WHERE list_bool_or(list_transform(features, lambda v: isnan(v) OR isinf(v)))) AS BIGINT) AS nan_inf_vectors,
  (SELECT avg(x) FROM x) AS mean, (SELECT stddev_pop(x) FROM x) AS std, (SELECT min(x) FROM x) AS min, (SELECT max(x) FROM x) AS max FROM r""",
    V,
)
def q_a47(spark, sf):
    return C.feature_stats(_vec(spark, sf))


@query(
    "m24_matrix_sanity",
    """SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (WHERE list_bool_or(list_transform(features, lambda v: isnan(v) OR isinf(v)))) AS BIGINT) AS nan_inf_vectors
FROM f_vectors""",
    V,
)
def q_m24(spark, sf):
    return C.feature_stats(_vec(spark, sf)).select("n_rows", "nan_inf_vectors")


@query("m01_embed_text")
def q_m01(spark, sf):
    e = C.embed_text(fx(spark, sf, "f_corpus"))
    return e.select("jd_id", F.size("features").alias("dims"), rnd(F.sqrt(F.aggregate("features", F.lit(0.0), lambda a, x: a + x * x)), 6).alias("norm"))


def counting_embedder():
    """A model that needs no files: characters and blanks of a text."""
    return lambda texts: np.array([[len(t), t.count(" ")] for t in texts], np.float32)


@query(
    "x02_embedder_hook",
    """SELECT jd_id, CASE WHEN t THEN 0 ELSE length(jd_text) END::DOUBLE AS n_chars, CASE WHEN t THEN 0 ELSE length(jd_text) - length(replace(jd_text, ' ', '')) END::DOUBLE AS n_blanks
FROM (SELECT jd_id, jd_text, NOT regexp_matches(coalesce(jd_text, ''), '[^\\s]') AS t FROM f_corpus)""",
    ("f_corpus",),
)
def q_x02(spark, sf):
    e = C.embed_with(fx(spark, sf, "f_corpus"), counting_embedder, 2)
    return e.select("jd_id", F.col("features")[0].cast("double").alias("n_chars"), F.col("features")[1].cast("double").alias("n_blanks"))


@query("m09_kmeans")
def q_m09(spark, sf):
    a, _, _ = C.kmeans(_vec(spark, sf), k=10)
    return a


@query("m10_hierarchical_ward")
def q_m10(spark, sf):
    return ward(_vec(spark, sf), k=10)


@query("m10_bisecting_kmeans")
def q_m10_bisecting(spark, sf):
    return C.bisecting(_vec(spark, sf), k=10)


@query("m12_find_optimal_k")
def q_m12(spark, sf):
    return C.find_optimal_k(_vec(spark, sf))


@query(
    "m13_silhouette",
    """WITH v AS (SELECT jd_id, label, CAST(features AS DOUBLE[]) AS x FROM f_vectors),
d AS (SELECT a.jd_id, a.label, b.label AS other, list_distance(a.x, b.x) AS d FROM v a JOIN v b ON a.jd_id <> b.jd_id),
m AS (SELECT jd_id, label, other, avg(d) AS d, avg(d * d) AS d2 FROM d GROUP BY jd_id, label, other),
s AS (SELECT jd_id, max(d) FILTER (other = label) AS a, min(d) FILTER (other <> label) AS b, max(d2) FILTER (other = label) AS a2, min(d2) FILTER (other <> label) AS b2 FROM m GROUP BY jd_id)
SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette,
  round(avg(CASE WHEN a2 IS NULL THEN 0 ELSE (b2 - a2) / greatest(a2, b2) END), 6) AS silhouette_sq, CAST(count(*) AS BIGINT) AS n_points FROM s""",
    V,
)
def q_m13(spark, sf):
    """Exact Euclidean silhouette of the given labels, and the form with squared distances."""
    v = _vec(spark, sf)
    points = indexed(v, "jd_id", "features")
    labels = points.join(v.select(F.col("jd_id").alias("id"), F.col("label").alias("cluster")), "id").select("p", "cluster", F.lit(0).alias("s"))
    out = D.silhouettes(Cells(points), labels, ["s"])
    return out.select(rnd("silhouette", 6).alias("silhouette"), rnd("silhouette_sq", 6).alias("silhouette_sq"), "n_points")


@query(
    "m14_core_distances",
    """WITH v AS (SELECT jd_id, CAST(features AS DOUBLE[]) AS x FROM f_vectors),
d AS (SELECT a.jd_id, list_distance(a.x, b.x) AS d FROM v a JOIN v b ON a.jd_id <> b.jd_id),
r AS (SELECT jd_id, d, row_number() OVER (PARTITION BY jd_id ORDER BY d) AS rank FROM d)
SELECT jd_id, round(d, 5) AS core_distance FROM r WHERE rank = 3""",
    V,
)
def q_m14_core(spark, sf):
    points = indexed(_vec(spark, sf), "jd_id", "features")
    cores = core_distances(points, nearest(Cells(points), D.MIN_SAMPLES), [D.MIN_SAMPLES])
    return points.join(cores, "p").select(F.col("id").alias("jd_id"), rnd("core", 5).alias("core_distance"))


@query("m14_density_cluster")
def q_m14(spark, sf):
    model = D.DensityModel(_vec(spark, sf), [D.MIN_SAMPLES])
    return D.density_clusters(model, [D.MIN_CLUSTER_SIZE]).select(F.col("id").alias("jd_id"), "cluster")


@query("m15_membership_scores")
def q_m15(spark, sf):
    model = D.DensityModel(_vec(spark, sf), [D.MIN_SAMPLES])
    return D.density_clusters(model, [D.MIN_CLUSTER_SIZE]).select(F.col("id").alias("jd_id"), "cluster", rnd("probability", 6).alias("probability"), rnd("outlier_score", 6).alias("outlier_score"))


@query("m16_density_param_grid")
def q_m16(spark, sf):
    return D.density_grid(_vec(spark, sf))


@query("m11_hierarchical_single")
def q_m11(spark, sf):
    return D.single_linkage(D.DensityModel(_vec(spark, sf), [0]), 10).withColumnRenamed("id", "jd_id")


@query("m22_density_assignments")
def q_m22_density(spark, sf):
    """Assignments of cluster 0 and of the noise points, with their scores (M22 over M14's result)."""
    model = D.DensityModel(_vec(spark, sf), [D.MIN_SAMPLES])
    rows = written(D.density_clusters(model, [D.MIN_CLUSTER_SIZE]), "assignments").select(F.col("id").alias("jd_id"), "cluster", "probability", "outlier_score")
    return rows.where("cluster = 0").unionByName(rows.where("cluster = -1"))


@query("m18_structure_kmeans")
def q_m18(spark, sf):
    parsed = S.parse_structure(fx(spark, sf, "f_sectioned"))
    types = S.all_section_types()
    vec = S.structure_vectors(parsed, types=types)
    feats = vec.select("jd_id", F.array(*[F.col(t).cast("float") for t in types]).alias("features"))
    a, _, _ = C.kmeans(feats, k=5)
    return S.structure_cluster_profile(vec, a, types)


@query("m20_project_2d")
def q_m20(spark, sf):
    return C.project_2d(_vec(spark, sf))


@query("m21_viz_points")
def q_m21(spark, sf):
    v = _vec(spark, sf)
    pts = C.project_2d(v)
    a, _, _ = C.kmeans(v, k=10)
    return pts.join(a, "jd_id").join(fx(spark, sf, "f_meta").select("jd_id", "title", "division"), "jd_id", "left")


@query("m02_embed_sections")
def q_m02(spark, sf):
    secs = S.section_filter(S.parse_corpus(fx(spark, sf, "f_sectioned")), ["summary", "responsibilities", "required_qualifications", "benefits"])
    # The texts are parsed once; counting words and weighting them both read the written sections.
    keyed = written(secs.select(F.concat_ws("|", "section_type", "jd_id").alias("key"), "content"), "m02-sections")
    e = C.embed_text(keyed, text_col="content", id_field="key")
    return e.select(F.split("key", "\\|")[0].alias("section_type"), F.split("key", "\\|")[1].alias("jd_id"), F.size("features").alias("dims"))


@query("m19_section_clustering")
def q_m19(spark, sf):
    """k-means per section type, k from the F10 gate (one small row per type drives the loop)."""
    secs = S.section_filter(S.parse_corpus(fx(spark, sf, "f_sectioned")), ["summary", "responsibilities", "required_qualifications", "benefits"])
    # The texts are parsed once: every type reads its sections from a written table.
    path = scratch_path(spark, f"m19-sections-{uuid.uuid4().hex}")
    secs.select("jd_id", "section_type", "content").write.partitionBy("section_type").parquet(path)
    secs = spark.read.parquet(path)
    gate = S.cluster_gate(secs).collect()
    keyed = secs.select(F.concat_ws("|", "section_type", "jd_id").alias("jd_id"), "section_type", "content")
    parts = []
    for g in gate:
        e = C.embed_text(keyed.where(F.col("section_type") == g["section_type"]), text_col="content", sparse=True)
        a, _, _ = C.kmeans(e, k=int(g["k"]), restarts=3, most=10)
        parts.append(a.select(F.lit(g["section_type"]).alias("section_type"), F.split("jd_id", "\\|")[1].alias("jd_id"), "cluster"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
