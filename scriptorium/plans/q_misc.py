"""Checked queries for inventory rows that other queries use internally:
F06, F09, J11, A24, A51, W03, W08, C03, C04, C07-C10, C12."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptorium.functions.numeric import rnd

from scriptorium.functions.dates import days_between, month_label, parse_date, quarter_label
from scriptorium.operators import archetypes as A
from scriptorium.operators import quality, sampling
from scriptorium.operators import structure as S
from scriptorium.plans.q_archetypes import BASE, MI
from scriptorium.plans.q_structure import PARSE_CTE
from scriptorium.plans.registry import fx, query


@query("f06_noise_filter", "SELECT jd_id, cluster FROM f_meta WHERE cluster <> -1", ("f_meta",))
def q_f06(spark, sf):
    return A.exclude_noise(fx(spark, sf, "f_meta").select("jd_id", "cluster"))


@query(
    "f09_valid_score_date",
    """WITH e AS (SELECT f.jd_id, CAST(c.posting_date AS TIMESTAMP) AS d, f.completeness AS s FROM f_evals f LEFT JOIN f_corpus c ON f.jd_id = c.jd_id
  WHERE TRY_CAST(c.posting_date AS TIMESTAMP) IS NOT NULL AND f.completeness IS NOT NULL)
SELECT jd_id, strftime(d, '%Y-%m-%d') AS d FROM e WHERE (SELECT count(*) FROM e) >= 5""",
    ("f_evals", "f_corpus"),
)
def q_f09(spark, sf):
    ev = fx(spark, sf, "f_evals").withColumn("average_score", F.col("completeness").cast("double"))
    m = quality.merge_metadata(ev, fx(spark, sf, "f_corpus"))
    v = quality._gate(quality._valid_dated(m, "posting_date"))
    return v.select("jd_id", F.date_format("_d", "yyyy-MM-dd").alias("d"))


@query(
    "j11_strata_lookup",
    """WITH cfg AS (SELECT org_unit, level, CAST(count(*) % 4 AS BIGINT) AS want FROM f_corpus GROUP BY 1, 2)
SELECT f.jd_id, cfg.want FROM f_corpus f JOIN cfg ON f.org_unit = cfg.org_unit AND f.level = cfg.level""",
    ("f_corpus",),
)
def q_j11(spark, sf):
    c = fx(spark, sf, "f_corpus")
    cfg = c.groupBy("org_unit", "level").agg((F.count(F.lit(1)) % 4).cast("bigint").alias("want"))
    # the configuration table is joined on the stratum keys; AQE broadcasts it when it is small
    return c.join(cfg, ["org_unit", "level"]).select("jd_id", "want")


_TYPES = S.all_section_types()


@query(
    "a24_structure_cluster_profile",
    f"""WITH RECURSIVE {PARSE_CTE}
, v AS (SELECT d.jd_id, """
    + ", ".join(f"CAST((SELECT count(*) FROM secs s WHERE s.jd_id = d.jd_id AND s.section_type = '{t}') > 0 AS INT) AS {t}" for t in _TYPES)
    + """ FROM f_sectioned d),
j AS (SELECT v.*, m.cluster FROM v JOIN f_meta m ON v.jd_id = m.jd_id)
SELECT cluster, CAST(count(*) AS BIGINT) AS size, round(count(*) / (SELECT count(*) FROM j), 3) AS percentage,
  concat_ws(',', """
    + ", ".join(f"CASE WHEN avg({t}) > 0.5 THEN '{t}' END" for t in _TYPES)
    + ") AS common, "
    + ", ".join(f"round(avg({t}), 2) AS presence_{t}" for t in _TYPES)
    + " FROM j GROUP BY cluster",
    ("f_sectioned", "f_meta"),
)
def q_a24(spark, sf):
    vec = S.structure_vectors(S.parse_structure(fx(spark, sf, "f_sectioned")), types=_TYPES)
    assign = fx(spark, sf, "f_meta").select("jd_id", "cluster")
    out = S.structure_cluster_profile(vec, assign, _TYPES)
    return out.withColumnRenamed("common_sections", "common")


@query(
    "a51_archetype_totals",
    f"""WITH {BASE}
SELECT CAST(count(*) AS BIGINT) AS archetypes, CAST(sum(member_count) AS BIGINT) AS members_covered, avg(member_count) AS avg_size,
  CAST(max(member_count) AS BIGINT) AS max_size, CAST(min(member_count) AS BIGINT) AS min_size FROM mc WHERE member_count > 0""",
    MI,
)
def q_a51(spark, sf):
    a = A.exclude_noise(fx(spark, sf, "f_meta").select("jd_id", "cluster"))
    m = A.member_counts(a, fx(spark, sf, "f_items")).where("member_count > 0")
    return m.agg(
        F.count(F.lit(1)).cast("bigint").alias("archetypes"),
        F.sum("member_count").cast("bigint").alias("members_covered"),
        F.avg("member_count").alias("avg_size"),
        F.max("member_count").cast("bigint").alias("max_size"),
        F.min("member_count").cast("bigint").alias("min_size"),
    )


@query(
    "w03_share_of_total",
    "SELECT division, CAST(count(*) AS BIGINT) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM f_meta GROUP BY 1",
    ("f_meta",),
)
def q_w03(spark, sf):
    g = fx(spark, sf, "f_meta").groupBy("division").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    # the window runs over the aggregated rows (one per division)
    return g.withColumn("pct", rnd(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))


@query(
    "w08_topk_per_group",
    """SELECT division, function, CAST(n AS BIGINT) AS n, CAST(r AS INT) AS rank FROM (
  SELECT division, function, count(*) AS n, row_number() OVER (PARTITION BY division ORDER BY count(*) DESC, function) AS r FROM f_meta GROUP BY 1, 2) WHERE r <= 3""",
    ("f_meta",),
)
def q_w08(spark, sf):
    c = fx(spark, sf, "f_meta").groupBy("division", "function").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    return A.rank_within(c, ["division"], [F.desc("n"), F.asc("function")], 3)


@query("c03_map_merge", f"WITH {BASE} SELECT cluster, item, freq FROM mergedmax", MI)
def q_c03(spark, sf):
    a = A.exclude_noise(fx(spark, sf, "f_meta").select("jd_id", "cluster"))
    return A.merged_skill_freq(A.item_frequency(a, fx(spark, sf, "f_items")), rule="max")


@query("c04_first_map_key", f"WITH {BASE} SELECT cluster, value AS top_function FROM dist WHERE field = 'function' AND rank = 1", MI)
def q_c04(spark, sf):
    a = A.exclude_noise(fx(spark, sf, "f_meta").select("jd_id", "cluster"))
    d = A.field_distribution(a, fx(spark, sf, "f_meta").drop("cluster"), fx(spark, sf, "f_items"), ("function",))
    return A.top_value(d, "function")


@query(
    "c07_parse_date",
    """SELECT jd_id, strftime(TRY_CAST(s AS TIMESTAMP), '%Y-%m-%d') AS d FROM (
  SELECT jd_id, CASE CAST(jd_id AS BIGINT) % 3 WHEN 0 THEN posting_date WHEN 1 THEN 'garbage ' || jd_id ELSE posting_date || 'T00:00:00' END AS s FROM f_corpus)""",
    ("f_corpus",),
)
def q_c07(spark, sf):
    c = fx(spark, sf, "f_corpus")
    k = F.col("jd_id").cast("bigint") % 3
    s = F.when(k == 0, F.col("posting_date")).when(k == 1, F.concat(F.lit("garbage "), F.col("jd_id"))).otherwise(F.concat(F.col("posting_date"), F.lit("T00:00:00")))
    return c.select("jd_id", F.date_format(parse_date(s), "yyyy-MM-dd").alias("d"))


@query(
    "c08_period",
    """SELECT jd_id, CAST(year(d) AS VARCHAR) || 'Q' || CAST(quarter(d) AS VARCHAR) AS quarter, strftime(d, '%Y-%m') AS month
FROM (SELECT jd_id, CAST(posting_date AS DATE) AS d FROM f_corpus)""",
    ("f_corpus",),
)
def q_c08(spark, sf):
    d = parse_date(F.col("posting_date"))
    return fx(spark, sf, "f_corpus").select("jd_id", quarter_label(d).alias("quarter"), month_label(d).alias("month"))


@query(
    "c09_days_between",
    "SELECT jd_id, CAST(date_diff('day', DATE '2024-01-01', CAST(posting_date AS DATE)) AS BIGINT) AS days FROM f_corpus",
    ("f_corpus",),
)
def q_c09(spark, sf):
    d = parse_date(F.col("posting_date"))
    return fx(spark, sf, "f_corpus").select("jd_id", days_between(d, F.lit("2024-01-01").cast("timestamp_ntz")).alias("days"))


@query(
    "c10_round_ratio",
    """SELECT cluster, round(coalesce(count(*) FILTER (WHERE years_min IS NULL) / nullif(count(*), 0), 0), 3) AS missing_years_rate
FROM f_meta GROUP BY 1""",
    ("f_meta",),
)
def q_c10(spark, sf):
    m = fx(spark, sf, "f_meta")
    return m.groupBy("cluster").agg(
        rnd(F.coalesce(F.count_if(F.col("years_min").isNull()) / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0)), 3).alias("missing_years_rate")
    )


@query(
    "c12_cast_int",
    """SELECT jd_id, CAST(TRY_CAST(TRY_CAST(s AS DOUBLE) AS INTEGER) AS DOUBLE) AS score FROM (
  SELECT jd_id, CASE CAST(jd_id AS BIGINT) % 4 WHEN 0 THEN CAST(completeness AS VARCHAR) WHEN 1 THEN CAST(completeness AS VARCHAR) || '.0'
    WHEN 2 THEN 'n/a' ELSE NULL END AS s FROM f_evals)""",
    ("f_evals",),
)
def q_c12(spark, sf):
    e = fx(spark, sf, "f_evals")
    k = F.col("jd_id").cast("bigint") % 4
    s = (
        F.when(k == 0, F.col("completeness").cast("string"))
        .when(k == 1, F.concat(F.col("completeness").cast("string"), F.lit(".0")))
        .when(k == 2, F.lit("n/a"))
    )
    raw = e.select("jd_id", s.alias("eval_completeness"), F.lit("1").alias("eval_overall_score"), F.col("jd_id").cast("bigint").alias("_o"))
    # score text -> int, NULL stays NULL (reported as DOUBLE: NULLs in both engines)
    return quality.import_csv_evaluations(raw, order_col="_o").select("jd_id", F.col("completeness").cast("double").alias("score"))
