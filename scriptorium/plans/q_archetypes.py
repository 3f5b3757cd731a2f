"""Checked queries: clusters, archetypes, joins, set operations, top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import archetypes as A
from scriptorium.plans.registry import fx, query

MI = ("f_meta", "f_items")
M = ("f_meta",)

BASE = """ext AS (SELECT DISTINCT jd_id FROM f_items),
a AS (SELECT jd_id, cluster FROM f_meta),
an AS (SELECT * FROM a WHERE cluster <> -1),
mc AS (SELECT x.cluster, CAST(count(*) AS BIGINT) AS member_total, CAST(count(e.jd_id) AS BIGINT) AS member_count
       FROM an x LEFT JOIN ext e ON x.jd_id = e.jd_id GROUP BY 1),
fr AS (SELECT x.cluster, i.category, i.kind, i.item, count(*) AS count FROM an x JOIN f_items i ON x.jd_id = i.jd_id GROUP BY 1, 2, 3, 4),
frq AS (SELECT fr.cluster, category, kind, item, CAST(count AS BIGINT) AS count, count / mc.member_count AS freq,
        row_number() OVER (PARTITION BY fr.cluster, category, kind ORDER BY count DESC, item) AS rank FROM fr JOIN mc ON fr.cluster = mc.cluster),
merged AS (SELECT cluster, item, arg_max(freq, (CASE category WHEN 'technical' THEN 0 WHEN 'domain' THEN 2 ELSE 4 END)
             + (CASE WHEN kind = 'preferred' THEN 1 ELSE 0 END)) AS freq
           FROM frq WHERE category IN ('technical', 'domain', 'soft') GROUP BY 1, 2),
mergedmax AS (SELECT cluster, item, max(freq) AS freq FROM frq WHERE category IN ('technical', 'domain', 'soft') GROUP BY 1, 2),
topsk AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY freq DESC, item) AS rank FROM merged),
em AS (SELECT m.* FROM f_meta m JOIN an x ON m.jd_id = x.jd_id WHERE m.jd_id IN (SELECT jd_id FROM ext)),
dist AS (SELECT cluster, field, value, CAST(c AS BIGINT) AS count, c / mc_count AS share,
           row_number() OVER (PARTITION BY cluster, field ORDER BY c DESC, value) AS rank FROM (
         SELECT l.cluster, field, value, count(*) AS c, max(mc.member_count) AS mc_count FROM (
           SELECT cluster, 'level' AS field, level AS value FROM em UNION ALL
           SELECT cluster, 'division', division FROM em UNION ALL SELECT cluster, 'function', function FROM em) l
         JOIN mc ON l.cluster = mc.cluster WHERE value IS NOT NULL AND value <> '' GROUP BY 1, 2, 3)),
titles AS (SELECT cluster, title, CAST(c AS BIGINT) AS count, row_number() OVER (PARTITION BY cluster ORDER BY c DESC, title) AS rank
           FROM (SELECT cluster, title, count(*) AS c FROM em WHERE title IS NOT NULL AND title <> '' GROUP BY 1, 2))"""


def W(body: str) -> str:
    return f"WITH {BASE}\n{body}"


def _meta(spark, sf):
    return fx(spark, sf, "f_meta")


def _items(spark, sf):
    return fx(spark, sf, "f_items")


def _assign(spark, sf):
    return _meta(spark, sf).select("jd_id", "cluster")


def _an(spark, sf):
    return A.exclude_noise(_assign(spark, sf))


# ---------------------------------------------------------------- cluster evaluation

@query("a25_cluster_sizes", "SELECT cluster, CAST(count(*) AS BIGINT) AS size FROM f_meta GROUP BY 1", M)
def q_a25(spark, sf):
    return A.cluster_sizes(_assign(spark, sf))


@query(
    "a25_cluster_summary",
    """SELECT CAST(count(DISTINCT CASE WHEN cluster <> -1 THEN cluster END) AS BIGINT) AS n_clusters,
  CAST(count(*) FILTER (WHERE cluster = -1) AS BIGINT) AS n_noise, round(count(*) FILTER (WHERE cluster = -1) / count(*), 4) AS noise_ratio FROM f_meta""",
    M,
)
def q_a25b(spark, sf):
    return A.cluster_summary(_assign(spark, sf))


_FIELDS = ["division", "function", "level"]


@query(
    "a26_cluster_composition",
    f"""WITH l AS ({' UNION ALL '.join(f"SELECT cluster, '{f}' AS field, CAST({f} AS VARCHAR) AS value FROM f_meta" for f in _FIELDS)}),
s AS (SELECT cluster, count(*) AS size FROM f_meta GROUP BY 1),
c AS (SELECT cluster, field, value, count(*) AS count FROM l WHERE value IS NOT NULL GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster, field ORDER BY count DESC, value) AS rank FROM c),
p AS (SELECT cluster, field, CAST(count(*) AS BIGINT) AS unique_values,
        string_agg(CASE WHEN rank <= 5 THEN value || ':' || CAST(count AS VARCHAR) END, ', ' ORDER BY rank) AS top_values,
        max(CASE WHEN rank = 1 THEN value END) AS tv, max(CASE WHEN rank = 1 THEN count END) AS tc FROM r GROUP BY 1, 2)
SELECT p.cluster, field, top_values, CASE WHEN tc * 100.0 / size > 40 THEN tv END AS dominant, round(tc * 100.0 / size, 1) AS dominant_pct,
  unique_values, CAST(size AS BIGINT) AS size, round(size * 100.0 / (SELECT count(*) FROM f_meta), 2) AS percentage
FROM p JOIN s ON p.cluster = s.cluster""",
    M,
)
def q_a26(spark, sf):
    return A.cluster_composition(_meta(spark, sf), _FIELDS)


_PUR = """WITH s AS (SELECT cluster, count(*) AS size FROM f_meta {w} GROUP BY 1),
c AS (SELECT cluster, level, count(*) AS mode_count FROM f_meta {w} GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY mode_count DESC, level) AS rn FROM c),
p AS (SELECT r.cluster, CAST(level AS VARCHAR) AS dominant_label, round(mode_count / size, 3) AS purity, CAST(size AS BIGINT) AS size,
      CAST(mode_count AS BIGINT) AS mode_count FROM r JOIN s ON r.cluster = s.cluster WHERE rn = 1)"""


@query("a27_cluster_purity", _PUR.format(w="") + " SELECT * FROM p", M)
def q_a27(spark, sf):
    return A.cluster_purity(_meta(spark, sf), "level")


@query(
    "a27_overall_purity",
    _PUR.format(w="WHERE cluster <> -1")
    + " SELECT round(sum(mode_count) / sum(size), 3) AS overall_purity, avg(purity) AS mean_purity, CAST(count(*) AS BIGINT) AS n_clusters FROM p",
    M,
)
def q_a27b(spark, sf):
    return A.overall_purity(_meta(spark, sf), "level", drop_noise=True)


@query(
    "a28_purity_rollup",
    _PUR.format(w="WHERE cluster <> -1")
    + """, d AS (SELECT cluster, count(DISTINCT level) AS n_labels FROM f_meta WHERE cluster <> -1 GROUP BY 1)
SELECT sum(purity * size) / sum(size) AS weighted_purity, avg(purity) AS mean_purity, avg(n_labels) AS mean_distinct_labels,
  CAST(max(n_labels) AS BIGINT) AS max_distinct_labels FROM p JOIN d ON p.cluster = d.cluster""",
    M,
)
def q_a28(spark, sf):
    return A.purity_rollup(_meta(spark, sf), "level")


@query(
    "a28_purity_histogram",
    _PUR.format(w="WHERE cluster <> -1")
    + " SELECT CAST(CASE WHEN purity >= 1.0 THEN 21 ELSE floor(purity * 20) + 1 END AS BIGINT) AS bucket, CAST(count(*) AS BIGINT) AS clusters FROM p GROUP BY 1",
    M,
)
def q_a28b(spark, sf):
    return A.purity_histogram(_meta(spark, sf), "level")


@query(
    "a29_crosstab_rows",
    "SELECT cluster, CAST(level AS VARCHAR) AS label, count(*) / sum(count(*)) OVER (PARTITION BY cluster) AS share FROM f_meta GROUP BY cluster, level",
    M,
)
def q_a29(spark, sf):
    return A.crosstab_share(_meta(spark, sf), "level")


@query(
    "a30_noise_profile",
    "SELECT level, CAST(count(*) AS BIGINT) AS count FROM f_meta WHERE cluster = -1 GROUP BY 1 ORDER BY count DESC, level LIMIT 20",
    M,
)
def q_a30(spark, sf):
    return A.noise_profile(_meta(spark, sf), "level")


@query(
    "a31_size_stats",
    """WITH s AS (SELECT cluster, count(*) AS size FROM f_meta WHERE cluster <> -1 GROUP BY 1)
SELECT CAST(min(size) AS BIGINT) AS min_size, CAST(max(size) AS BIGINT) AS max_size, avg(size) AS mean_size,
  quantile_cont(size, 0.5) AS median_size, stddev_pop(size) AS std_size FROM s""",
    M,
)
def q_a31(spark, sf):
    return A.size_stats(_assign(spark, sf))


# ---------------------------------------------------------------- archetype parts

@query("j10_member_extraction", W("SELECT cluster, member_count, member_total FROM mc"), MI)
def q_j10(spark, sf):
    return A.member_counts(_an(spark, sf), _items(spark, sf))


@query("a32_item_frequency", W("SELECT cluster, category, kind, item, count, freq, CAST(rank AS INT) AS rank FROM frq"), MI)
def q_a32(spark, sf):
    return A.item_frequency(_an(spark, sf), _items(spark, sf))


@query("a33_field_distribution", W("SELECT cluster, field, value, count, share, CAST(rank AS INT) AS rank FROM dist"), MI)
def q_a33(spark, sf):
    return A.field_distribution(_an(spark, sf), _meta(spark, sf), _items(spark, sf))


@query("a34_representative_titles", W("SELECT cluster, CAST(rank AS INT) AS rank, title, count FROM titles WHERE rank <= 5"), MI)
def q_a34(spark, sf):
    return A.representative_titles(_an(spark, sf), _meta(spark, sf), _items(spark, sf))


@query(
    "a35_years_stats",
    W(
        """SELECT cluster, quantile_cont(years_min, 0.5) AS years_min_median, quantile_cont(years_preferred, 0.5) AS years_preferred_median,
  CAST(coalesce(min(years_min), 0) AS BIGINT) AS range_low, CAST(coalesce(max(years_preferred), max(years_min), 0) AS BIGINT) AS range_high
FROM (SELECT e.*, x.cluster AS cl FROM em e JOIN an x ON e.jd_id = x.jd_id) GROUP BY cluster"""
    ),
    MI,
)
def q_a35(spark, sf):
    return A.years_stats(_an(spark, sf), _meta(spark, sf).drop("cluster"), _items(spark, sf))


@query(
    "a36_centroid",
    """SELECT label AS cluster, CAST(i - 1 AS BIGINT) AS dim, avg(CAST(x AS DOUBLE)) AS value
FROM (SELECT label, unnest(features) AS x, unnest(range(1, len(features) + 1)) AS i FROM f_vectors) GROUP BY 1, 2""",
    ("f_vectors",),
)
def q_a36(spark, sf):
    v = fx(spark, sf, "f_vectors")
    return A.centroids(v, v.select("jd_id", F.col("label").alias("cluster")))


@query("a38_top_skills", W("SELECT cluster, item, freq, CAST(rank AS INT) AS rank FROM topsk WHERE rank <= 5"), MI)
def q_a38(spark, sf):
    return A.top_skills(A.item_frequency(_an(spark, sf), _items(spark, sf)))


@query(
    "a39_archetype_summary",
    W(
        """SELECT mc.cluster AS cluster_id, mc.member_count,
  coalesce((SELECT string_agg(title, '; ' ORDER BY rank) FROM titles t WHERE t.cluster = mc.cluster AND rank <= 3), '') AS representative_titles,
  coalesce((SELECT string_agg(item, '; ' ORDER BY rank) FROM topsk s WHERE s.cluster = mc.cluster AND rank <= 5), '') AS top_skills,
  coalesce((SELECT value FROM dist d WHERE d.cluster = mc.cluster AND field = 'division' AND rank = 1), '') AS top_division
FROM mc WHERE member_count > 0"""
    ),
    MI,
)
def q_a39(spark, sf):
    return A.archetype_summary(_assign(spark, sf), _meta(spark, sf).drop("cluster"), _items(spark, sf))


@query(
    "a37_archetype_assemble",
    W(
        """SELECT mc.cluster, mc.member_count, mc.member_total AS n_member_ids,
  (SELECT CAST(count(*) AS BIGINT) FROM frq f WHERE f.cluster = mc.cluster) AS n_frequencies,
  (SELECT CAST(count(*) AS BIGINT) FROM titles t WHERE t.cluster = mc.cluster AND rank <= 5) AS n_titles,
  (SELECT CAST(count(*) AS BIGINT) FROM dist d WHERE d.cluster = mc.cluster) AS n_distribution_values
FROM mc WHERE member_count > 0"""
    ),
    MI,
)
def q_a37(spark, sf):
    r = A.archetype_records(_assign(spark, sf), _meta(spark, sf).drop("cluster"), _items(spark, sf))
    cats = ["technical", "domain", "soft", "tools", "licenses", "certifications", "languages"]
    freq_cols = [f"{c}_{k}" for c in cats for k in A.KINDS if f"{c}_{k}" in r.columns]
    n_freq = sum((F.coalesce(F.size(F.col(c)), F.lit(0)) for c in freq_cols), F.lit(0))
    n_dist = sum((F.coalesce(F.size(F.col(f)), F.lit(0)) for f in ["level", "division", "function"]), F.lit(0))
    return r.select(
        "cluster",
        "member_count",
        F.col("member_total").cast("bigint").alias("n_member_ids"),
        n_freq.cast("bigint").alias("n_frequencies"),
        F.size("representative_titles").cast("bigint").alias("n_titles"),
        n_dist.cast("bigint").alias("n_distribution_values"),
    )


@query(
    "a40_skill_totals",
    W("SELECT m.item, sum(m.freq * mc.member_count) AS total FROM merged m JOIN mc ON m.cluster = mc.cluster GROUP BY 1 ORDER BY total DESC, item LIMIT 30"),
    MI,
)
def q_a40(spark, sf):
    return A.skill_totals(_assign(spark, sf), _items(spark, sf))


@query(
    "a41_skill_matrix",
    W(
        """, top AS (SELECT m.item FROM merged m JOIN mc ON m.cluster = mc.cluster GROUP BY 1 ORDER BY sum(m.freq * mc.member_count) DESC, item LIMIT 30),
cl AS (SELECT cluster FROM mc WHERE member_count > 0)
SELECT cl.cluster, top.item, coalesce(x.freq, 0.0) AS value FROM cl CROSS JOIN top LEFT JOIN mergedmax x ON x.cluster = cl.cluster AND x.item = top.item"""
    ).replace("\n, top AS", ",\ntop AS"),
    MI,
)
def q_a41(spark, sf):
    return A.skill_matrix(_assign(spark, sf), _items(spark, sf))


@query(
    "a52_cluster_skill_sample",
    """WITH an AS (SELECT jd_id, cluster FROM f_meta WHERE cluster <> -1),
big AS (SELECT cluster FROM an GROUP BY 1 ORDER BY count(*) DESC, cluster LIMIT 5),
c AS (SELECT x.cluster, i.item, count(*) AS count FROM an x JOIN f_items i ON x.jd_id = i.jd_id
      WHERE x.cluster IN (SELECT cluster FROM big) AND i.category IN ('technical', 'domain', 'soft') GROUP BY 1, 2)
SELECT cluster, item, CAST(count AS BIGINT) AS count, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY count DESC, item) AS rank FROM c) WHERE rank <= 10""",
    MI,
)
def q_a52(spark, sf):
    return A.cluster_skill_sample(_assign(spark, sf), _items(spark, sf))


@query(
    "j14_grid_zero_fill",
    """WITH an AS (SELECT * FROM f_meta WHERE cluster <> -1),
r AS (SELECT DISTINCT cluster FROM an), c AS (SELECT DISTINCT division FROM an),
n AS (SELECT cluster, division, count(*) AS k FROM an GROUP BY 1, 2)
SELECT r.cluster, c.division, CAST(coalesce(n.k, 0) AS BIGINT) AS count FROM r CROSS JOIN c
LEFT JOIN n ON n.cluster = r.cluster AND n.division = c.division""",
    M,
)
def q_j14(spark, sf):
    return A.grid_zero_fill(A.exclude_noise(_meta(spark, sf)), "cluster", "division")


@query(
    "m22_assignments",
    "SELECT jd_id, cluster FROM f_meta WHERE cluster = 3 UNION ALL SELECT jd_id, cluster FROM f_meta WHERE cluster = -1",
    M,
)
def q_m22(spark, sf):
    a = _assign(spark, sf)
    return a.where(F.col("cluster") == 3).unionByName(a.where(F.col("cluster") == -1))


@query(
    "m23_cluster_examples",
    """SELECT cluster, CAST(rank AS INT) AS rank, jd_id, title, text_preview FROM (
  SELECT m.cluster, m.jd_id, c.title, substr(c.jd_text, 1, 500) || '...' AS text_preview,
    row_number() OVER (PARTITION BY m.cluster ORDER BY md5(m.jd_id || '42'), m.jd_id) AS rank
  FROM f_corpus c JOIN f_meta m ON c.jd_id = m.jd_id) WHERE rank <= 3""",
    ("f_corpus", "f_meta"),
)
def q_m23(spark, sf):
    corpus = fx(spark, sf, "f_corpus")
    return A.cluster_examples(corpus.join(_assign(spark, sf), "jd_id"))


# ---------------------------------------------------------------- joins

@query(
    "j02_assign_inner",
    "SELECT c.jd_id, m.cluster, c.title FROM f_corpus c JOIN f_meta m ON c.jd_id = m.jd_id",
    ("f_corpus", "f_meta"),
)
def q_j02(spark, sf):
    return fx(spark, sf, "f_corpus").join(_assign(spark, sf), "jd_id", "inner").select("jd_id", "cluster", "title")


@query(
    "j03_viz_left_meta",
    """SELECT v.jd_id, CAST(v.features[1] AS DOUBLE) AS x, CAST(v.features[2] AS DOUBLE) AS y, m.title, m.division
FROM f_vectors v LEFT JOIN f_meta m ON v.jd_id = m.jd_id""",
    ("f_vectors", "f_meta"),
)
def q_j03(spark, sf):
    v = fx(spark, sf, "f_vectors").select(
        "jd_id", F.col("features")[0].cast("double").alias("x"), F.col("features")[1].cast("double").alias("y")
    )
    return v.join(_meta(spark, sf).select("jd_id", "title", "division"), "jd_id", "left")


@query(
    "j04_id_map_inner",
    "SELECT d.jd_id, m.cluster FROM (SELECT DISTINCT jd_id FROM f_items) d JOIN f_meta m ON d.jd_id = m.jd_id",
    MI,
)
def q_j04(spark, sf):
    return _items(spark, sf).select("jd_id").distinct().join(_assign(spark, sf), "jd_id", "inner")


@query(
    "j05_id_map_default",
    "SELECT v.jd_id, coalesce(m.cluster, -2) AS cluster, CASE coalesce(m.cluster, -2) WHEN -2 THEN 'Unmatched' WHEN -1 THEN 'Noise' ELSE 'Cluster ' || CAST(m.cluster AS VARCHAR) END AS cluster_label FROM f_vectors v LEFT JOIN f_meta m ON v.jd_id = m.jd_id",
    ("f_vectors", "f_meta"),
)
def q_j05(spark, sf):
    v = fx(spark, sf, "f_vectors").select("jd_id")
    j = v.join(_assign(spark, sf), "jd_id", "left").select("jd_id", F.coalesce("cluster", F.lit(-2)).alias("cluster"))
    return j.withColumn("cluster_label", T.cluster_label("cluster"))


@query(
    "j06_gold_semi",
    "SELECT jd_id, title FROM f_meta WHERE jd_id IN (SELECT jd_id FROM f_meta WHERE cluster = -1)",
    M,
)
def q_j06(spark, sf):
    m = _meta(spark, sf)
    return m.join(m.where(F.col("cluster") == -1).select("jd_id"), "jd_id", "left_semi").select("jd_id", "title")


@query(
    "j09_mapping_left",
    """SELECT i.jd_id, i.pos, coalesce(s.standardized, i.item) AS item FROM f_items i LEFT JOIN f_skill_map s ON i.item = s.original""",
    ("f_items", "f_skill_map"),
)
def q_j09(spark, sf):
    from scriptorium.operators.naming import apply_mapping

    return apply_mapping(_items(spark, sf), fx(spark, sf, "f_skill_map")).select("jd_id", "pos", "item")


@query(
    "j12_pair_full_outer",
    W(
        """SELECT coalesce(a.item, b.item) AS item, coalesce(a.freq, 0.0) AS freq_a, coalesce(b.freq, 0.0) AS freq_b,
  coalesce(a.freq, 0.0) - coalesce(b.freq, 0.0) AS diff, a.item IS NULL AS only_b, b.item IS NULL AS only_a
FROM (SELECT * FROM merged WHERE cluster = 1) a FULL OUTER JOIN (SELECT * FROM merged WHERE cluster = 2) b ON a.item = b.item"""
    ),
    MI,
)
def q_j12(spark, sf):
    from scriptorium.operators.naming import compare_archetypes

    m = A.merged_skill_freq(A.item_frequency(_an(spark, sf), _items(spark, sf)))
    return compare_archetypes(m, 1, 2)


@query(
    "j13_id_overlap",
    """SELECT CAST(count(*) FILTER (WHERE a IS NOT NULL) AS BIGINT) AS in_a, CAST(count(*) FILTER (WHERE b IS NOT NULL) AS BIGINT) AS in_b,
  CAST(count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS BIGINT) AS in_both
FROM (SELECT DISTINCT jd_id AS a FROM f_vectors) x FULL OUTER JOIN (SELECT DISTINCT jd_id AS b FROM f_meta) y ON x.a = y.b""",
    ("f_vectors", "f_meta"),
)
def q_j13(spark, sf):
    from scriptorium.operators.naming import id_overlap

    return id_overlap(fx(spark, sf, "f_vectors"), _meta(spark, sf))


# ---------------------------------------------------------------- set operations and top-k

@query(
    "u01_union_all",
    "SELECT jd_id, 'old' AS src FROM f_meta WHERE cluster = -1 UNION ALL SELECT jd_id, 'new' FROM f_meta WHERE cluster = 0",
    M,
)
def q_u01(spark, sf):
    m = _meta(spark, sf)
    return m.where("cluster = -1").select("jd_id", F.lit("old").alias("src")).unionByName(
        m.where("cluster = 0").select("jd_id", F.lit("new").alias("src"))
    )


@query("u02_distinct", "SELECT DISTINCT category, item FROM f_items", ("f_items",))
def q_u02(spark, sf):
    return _items(spark, sf).select("category", "item").distinct()


_SK = "SELECT DISTINCT i.item FROM f_items i JOIN f_meta m ON i.jd_id = m.jd_id WHERE m.cluster = {c} AND i.category = 'technical'"


@query("u03_except", f"{_SK.format(c=1)} EXCEPT {_SK.format(c=2)}", MI)
def q_u03(spark, sf):
    s1, s2 = (_tech_items(spark, sf, c) for c in (1, 2))
    return s1.subtract(s2)


@query("u04_intersect", "SELECT jd_id FROM f_vectors INTERSECT SELECT jd_id FROM f_meta", ("f_vectors", "f_meta"))
def q_u04(spark, sf):
    return fx(spark, sf, "f_vectors").select("jd_id").intersect(_meta(spark, sf).select("jd_id"))


@query("u05_union_distinct", f"{_SK.format(c=1)} UNION {_SK.format(c=2)}", MI)
def q_u05(spark, sf):
    return _tech_items(spark, sf, 1).union(_tech_items(spark, sf, 2)).distinct()


def _tech_items(spark, sf, c):
    m = _meta(spark, sf).where(F.col("cluster") == c).select("jd_id")
    return _items(spark, sf).where(F.col("category") == "technical").join(m, "jd_id").select("item").distinct()


@query(
    "o01_sort_desc",
    "SELECT cluster, CAST(count(*) AS BIGINT) AS size FROM f_meta GROUP BY 1 ORDER BY size DESC, cluster",
    M,
)
def q_o01(spark, sf):
    return A.cluster_sizes(_assign(spark, sf)).orderBy(F.desc("size"), F.asc("cluster"))


@query("o02_head", "SELECT jd_id, title FROM f_meta ORDER BY CAST(jd_id AS BIGINT) LIMIT 10", M)
def q_o02(spark, sf):
    return _meta(spark, sf).orderBy(F.col("jd_id").cast("bigint")).limit(10).select("jd_id", "title")


@query(
    "o03_most_common",
    "SELECT item, CAST(count(*) AS BIGINT) AS count FROM f_items GROUP BY 1 ORDER BY count DESC, item LIMIT 15",
    ("f_items",),
)
def q_o03(spark, sf):
    return _items(spark, sf).groupBy("item").agg(F.count(F.lit(1)).cast("bigint").alias("count")).orderBy(F.desc("count"), "item").limit(15)


@query(
    "o04_argmax",
    "SELECT arg_max(cluster, size) AS best_cluster, max(size) AS best_size FROM (SELECT cluster, CAST(count(*) * 1000 + cluster AS BIGINT) AS size FROM f_meta WHERE cluster <> -1 GROUP BY 1)",
    M,
)
def q_o04(spark, sf):
    s = A.cluster_sizes(_an(spark, sf)).select("cluster", (F.col("size") * 1000 + F.col("cluster")).cast("bigint").alias("size"))
    return s.agg(F.max_by("cluster", "size").alias("best_cluster"), F.max("size").alias("best_size"))
