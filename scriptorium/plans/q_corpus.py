"""Checked queries: cleaning, corpus statistics, sampling, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import cleaning, quality, sampling
from scriptorium.plans.registry import fx, query
from scriptorium.sources.tables import table

CORPUS = ("f_corpus",)

# DuckDB text of the cleaning steps for text without entities or exotic blanks.
_SQ = "trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
_MOJI = (
    "replace(replace(replace(replace(replace(replace(replace({x}, 'â€™', ''''), 'â€œ', '\"'), 'â€', '\"'),"
    " 'â€\"', '—'), 'â€\"', '-'), 'Â', ''), chr(0), '')"
)
_TAGS = "regexp_replace({x}, '<[^>]+>', ' ', 'g')"
_ENT = (
    "regexp_replace(replace(replace(replace({x}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g')"
)

CLEAN_CTE = f"""cl0 AS (SELECT *, CASE WHEN length(jd_text) > 0 THEN {_TAGS.format(x='jd_text')} ELSE jd_text END AS t1 FROM f_corpus),
cl1 AS (SELECT *, CASE WHEN length(t1) > 0 THEN {_SQ.format(x='t1')} ELSE t1 END AS t2 FROM cl0),
cl2 AS (SELECT *, CASE WHEN length(t2) > 0 THEN {_MOJI.format(x='t2')} ELSE t2 END AS t3 FROM cl1),
clean AS (SELECT jd_id, org_unit, level, title, function, posting_date, t3 AS jd_text FROM cl2
          WHERE t3 IS NOT NULL AND length(t3) > 0 AND length(t3) >= 50)"""


def _corpus(spark, sf):
    return fx(spark, sf, "f_corpus")


def _clean(spark, sf):
    return cleaning.clean_corpus(_corpus(spark, sf))


@query("t01_strip_html", f"SELECT page_id, {_TAGS.format(x=_ENT.format(x='html'))} AS text FROM f_markup", ["f_markup"])
def q_t01(spark, sf):
    return fx(spark, sf, "f_markup").select("page_id", T.strip_html("html").alias("text"))


@query("t02_squeeze_whitespace", f"SELECT jd_id, {_SQ.format(x='jd_text')} AS text FROM f_corpus", CORPUS)
def q_t02(spark, sf):
    return _corpus(spark, sf).select("jd_id", T.squeeze_whitespace("jd_text").alias("text"))


@query("t03_fix_mojibake", f"SELECT jd_id, {_MOJI.format(x='jd_text')} AS text FROM f_corpus", CORPUS)
def q_t03(spark, sf):
    return _corpus(spark, sf).select("jd_id", T.fix_mojibake("jd_text").alias("text"))


@query(
    "t04_clean_text",
    f"""WITH {CLEAN_CTE.split(',' + chr(10) + 'clean AS')[0]}
SELECT jd_id, t3 AS clean, CAST(length(jd_text) AS BIGINT) AS len_before, CAST(coalesce(length(t3), 0) AS BIGINT) AS len_after,
  coalesce(length(jd_text) > 0 AND t1 <> jd_text, false) AS html_changed,
  coalesce(length(t1) > 0 AND t2 <> t1, false) AS ws_changed,
  coalesce(length(t2) > 0 AND t3 <> t2, false) AS enc_changed
FROM cl2""",
    CORPUS,
)
def q_t04(spark, sf):
    return cleaning.with_clean_text(_corpus(spark, sf)).select("jd_id", "_clean.*")


@query("t05_text_length", "SELECT jd_id, CAST(length(jd_text) AS BIGINT) AS text_length FROM f_corpus", CORPUS)
def q_t05(spark, sf):
    return _corpus(spark, sf).select("jd_id", T.text_length("jd_text").alias("text_length"))


@query(
    "t06_preview",
    """SELECT jd_id, CASE WHEN length(jd_text) > 200 THEN substr(jd_text, 1, 200) || '...' ELSE jd_text END AS preview_200,
  substr(jd_text, 1, 500) || '...' AS preview_500 FROM f_corpus""",
    CORPUS,
)
def q_t06(spark, sf):
    c = _corpus(spark, sf)
    return c.select("jd_id", T.preview("jd_text", 200).alias("preview_200"), T.preview("jd_text", 500, True).alias("preview_500"))


@query(
    "t17_nonblank",
    "SELECT count(*) FILTER (WHERE length(trim(jd_text)) > 0) AS usable, count(*) FILTER (WHERE NOT length(trim(jd_text)) > 0) AS blank FROM f_corpus",
    CORPUS,
)
def q_t17(spark, sf):
    ok = T.nonblank("jd_text")
    return _corpus(spark, sf).agg(F.count_if(ok).alias("usable"), F.count_if(~ok).alias("blank"))


@query(
    "f01_has_text",
    f"WITH {CLEAN_CTE} SELECT jd_id, CAST(length(jd_text) AS BIGINT) AS n FROM cl2 WHERE t3 IS NOT NULL AND length(t3) > 0",
    CORPUS,
)
def q_f01(spark, sf):
    c = cleaning.with_clean_text(_corpus(spark, sf))
    return c.where(T.has_text(F.col("_clean.clean"))).select("jd_id", F.length("jd_text").cast("bigint").alias("n"))


@query("f02_min_length", f"WITH {CLEAN_CTE} SELECT jd_id, CAST(length(jd_text) AS BIGINT) AS n FROM clean", CORPUS)
def q_f02(spark, sf):
    return _clean(spark, sf).select("jd_id", F.length("jd_text").cast("bigint").alias("n"))


@query(
    "a04_cleaning_stats",
    f"""WITH {CLEAN_CTE.split(',' + chr(10) + 'clean AS')[0]}
SELECT CAST(count(*) AS BIGINT) AS total_records,
  CAST(count(*) FILTER (WHERE t3 IS NOT NULL AND length(t3) > 0) AS BIGINT) AS records_with_text,
  CAST(count(*) FILTER (WHERE NOT (t3 IS NOT NULL AND length(t3) > 0) OR t3 IS NULL) AS BIGINT) AS records_missing_text,
  round(count(*) FILTER (WHERE t3 IS NOT NULL AND length(t3) > 0) / greatest(count(*), 1), 3) AS text_coverage_rate,
  CAST(count(*) FILTER (WHERE length(jd_text) > 0 AND t1 <> jd_text) AS BIGINT) AS html_tags_removed,
  CAST(count(*) FILTER (WHERE length(t1) > 0 AND t2 <> t1) AS BIGINT) AS extra_whitespace_cleaned,
  CAST(count(*) FILTER (WHERE length(t2) > 0 AND t3 <> t2) AS BIGINT) AS encoding_issues_fixed,
  CAST(coalesce(min(length(jd_text)), 0) AS BIGINT) AS len_before_min, CAST(coalesce(max(length(jd_text)), 0) AS BIGINT) AS len_before_max,
  coalesce(round(avg(length(jd_text)), 1), 0) AS len_before_avg,
  CAST(coalesce(min(CASE WHEN jd_text IS NOT NULL THEN coalesce(length(t3), 0) END), 0) AS BIGINT) AS len_after_min,
  CAST(coalesce(max(CASE WHEN jd_text IS NOT NULL THEN coalesce(length(t3), 0) END), 0) AS BIGINT) AS len_after_max,
  coalesce(round(avg(CASE WHEN jd_text IS NOT NULL THEN coalesce(length(t3), 0) END), 1), 0) AS len_after_avg,
  CAST(count(*) FILTER (WHERE NOT (t3 IS NOT NULL AND length(t3) > 0)) AS BIGINT) AS dropped_missing_text,
  CAST(count(*) FILTER (WHERE t3 IS NOT NULL AND length(t3) > 0 AND length(t3) < 50) AS BIGINT) AS dropped_text_too_short
FROM cl2""",
    CORPUS,
)
def q_a04(spark, sf):
    return cleaning.cleaning_stats(_corpus(spark, sf))


_FIELDS = ["jd_id", "jd_text", "org_unit", "level", "title", "function", "posting_date"]


@query(
    "a05_fill_rates",
    f"WITH {CLEAN_CTE} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS field, coalesce(round(count({c}) / count(*), 3), 0.0) AS rate FROM clean" for c in _FIELDS
    ),
    CORPUS,
)
def q_a05(spark, sf):
    return cleaning.fill_rates(_clean(spark, sf).select(*_FIELDS))


_CATS = ["org_unit", "level", "title", "function"]


@query(
    "a06_value_counts",
    f"""WITH {CLEAN_CTE},
long AS ({' UNION ALL '.join(f"SELECT '{c}' AS field, CAST({c} AS VARCHAR) AS value FROM clean" for c in _CATS)}),
cnt AS (SELECT field, value, count(*) AS count FROM long WHERE value IS NOT NULL GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY count DESC, value) AS rank FROM cnt)
SELECT field, value, CAST(count AS BIGINT) AS count, CAST(rank AS BIGINT) AS rank FROM rk WHERE rank <= 20""",
    CORPUS,
)
def q_a06(spark, sf):
    return cleaning.value_counts(_clean(spark, sf), _CATS, 20)


@query(
    "a07_length_describe",
    f"""WITH {CLEAN_CTE}
SELECT CAST(count(x) AS BIGINT) AS count, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS min,
  quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.75) AS p75, max(x) AS max
FROM (SELECT CAST(length(jd_text) AS DOUBLE) AS x FROM clean)""",
    CORPUS,
)
def q_a07(spark, sf):
    return cleaning.text_length_describe(_clean(spark, sf))


@query(
    "a08_corpus_stats",
    f"""WITH {CLEAN_CTE}
SELECT CAST(count(*) AS BIGINT) AS total_jds, CAST(count(DISTINCT title) AS BIGINT) AS unique_titles,
  CAST(count(DISTINCT org_unit) AS BIGINT) AS unique_org_units, CAST(count(DISTINCT level) AS BIGINT) AS unique_levels,
  round(avg(length(jd_text)), 1) AS avg_text_length, CAST(min(length(jd_text)) AS BIGINT) AS min_text_length,
  CAST(max(length(jd_text)) AS BIGINT) AS max_text_length,
  strftime(min(CAST(posting_date AS DATE)), '%Y-%m-%d') AS earliest_date, strftime(max(CAST(posting_date AS DATE)), '%Y-%m-%d') AS latest_date
FROM clean""",
    CORPUS,
)
def q_a08(spark, sf):
    return cleaning.corpus_stats(_clean(spark, sf))


# ---------------------------------------------------------------- sampling

@query(
    "a09_strata_distribution",
    """WITH g AS (SELECT org_unit, level, count(*) AS c FROM f_corpus WHERE org_unit IS NOT NULL AND level IS NOT NULL GROUP BY 1, 2)
SELECT org_unit, level, CAST(c AS BIGINT) AS count, round(c * 100.0 / (SELECT sum(c) FROM g), 2) AS percentage FROM g""",
    CORPUS,
)
def q_a09(spark, sf):
    return sampling.strata_distribution(_corpus(spark, sf))


_STRAT_SQL = """WITH keyed AS (SELECT * FROM f_corpus WHERE org_unit IS NOT NULL AND level IS NOT NULL),
strata AS (SELECT org_unit, level, count(*) AS size FROM keyed GROUP BY 1, 2),
s1 AS (SELECT *, coalesce(sum(least(1, size)) OVER (ORDER BY org_unit, level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM strata),
s2 AS (SELECT *, greatest(0, least(least(1, size), 100 - before)) AS p1 FROM s1),
rem AS (SELECT 100 - sum(p1) AS remaining FROM s2),
tot AS (SELECT count(*) AS total FROM f_corpus),
alloc AS (SELECT org_unit, level, p1,
  CASE WHEN remaining > 0 AND size - (CASE WHEN size >= 1 THEN 1 ELSE size END) > 0
       THEN least(floor(size / total * remaining), size - (CASE WHEN size >= 1 THEN 1 ELSE size END)) ELSE 0 END AS p2
  FROM s2, rem, tot),
ranked AS (SELECT k.*, row_number() OVER (PARTITION BY org_unit, level ORDER BY md5(jd_id || '42'), jd_id) AS rn FROM keyed k),
picked AS (SELECT r.jd_id, r.org_unit, r.level, CASE WHEN rn <= p1 THEN 1 ELSE 2 END AS sample_pass
  FROM ranked r JOIN alloc a ON r.org_unit = a.org_unit AND r.level = a.level WHERE rn <= p1 + p2),
rest AS (SELECT jd_id, org_unit, level, row_number() OVER (ORDER BY md5(jd_id || '42'), jd_id) AS rn
  FROM f_corpus WHERE jd_id NOT IN (SELECT jd_id FROM picked))
SELECT jd_id, org_unit, level, CAST(sample_pass AS BIGINT) AS sample_pass FROM picked
UNION ALL
SELECT jd_id, org_unit, level, CAST(3 AS BIGINT) FROM rest WHERE rn <= 100 - (SELECT count(*) FROM picked)"""


@query("w04_stratified_sample", _STRAT_SQL, CORPUS)
def q_w04(spark, sf):
    s = sampling.sample_stratified(_corpus(spark, sf), n=100, min_per_stratum=1, seed=42)
    return s.select("jd_id", "org_unit", "level", F.col("sample_pass").cast("bigint"))


@query(
    "w05_sample_by_strata",
    """WITH cfg AS (SELECT org_unit, level, 1 + CAST(count(*) % 3 AS BIGINT) AS want FROM f_corpus GROUP BY 1, 2),
r AS (SELECT f.jd_id, f.org_unit, f.level, row_number() OVER (PARTITION BY f.org_unit, f.level ORDER BY md5(f.jd_id || '42'), f.jd_id) AS rn FROM f_corpus f)
SELECT r.jd_id, r.org_unit, r.level FROM r JOIN cfg ON r.org_unit = cfg.org_unit AND r.level = cfg.level WHERE rn <= want""",
    CORPUS,
)
def q_w05(spark, sf):
    c = _corpus(spark, sf)
    cfg = c.groupBy("org_unit", "level").agg((1 + F.count(F.lit(1)) % 3).cast("bigint").alias("count"))
    return sampling.sample_by_strata(c, cfg).select("jd_id", "org_unit", "level")


@query(
    "w06_random_sample",
    "SELECT jd_id, title FROM f_corpus ORDER BY md5(jd_id || '42'), jd_id LIMIT 100",
    CORPUS,
)
def q_w06(spark, sf):
    return sampling.random_sample(_corpus(spark, sf), 100, 42).select("jd_id", "title")


@query(
    "w07_first_per_key",
    """SELECT jd_id, doc_len FROM (SELECT jd_id, CAST(length(jd_text) AS BIGINT) AS doc_len,
  row_number() OVER (PARTITION BY jd_text ORDER BY CAST(jd_id AS BIGINT)) AS rn FROM f_corpus) WHERE rn = 1""",
    CORPUS,
)
def q_w07(spark, sf):
    # drop_duplicates on the text: the first record (by id) of each distinct text
    c = _corpus(spark, sf)
    return sampling.first_per_key(c, "jd_text", F.col("jd_id").cast("bigint")).select(
        "jd_id", F.length("jd_text").cast("bigint").alias("doc_len")
    )


@query(
    "j08_remainder_anti",
    """WITH s AS (SELECT jd_id FROM f_corpus ORDER BY md5(jd_id || '42'), jd_id LIMIT 100)
SELECT jd_id FROM f_corpus WHERE jd_id NOT IN (SELECT jd_id FROM s)""",
    CORPUS,
)
def q_j08(spark, sf):
    c = _corpus(spark, sf)
    return sampling.not_sampled(c, sampling.random_sample(c, 100, 42)).select("jd_id")


# ---------------------------------------------------------------- quality

_RUBRIC = """rub AS (SELECT *, CASE WHEN (CASE WHEN completeness IS NULL THEN 0 ELSE 1 END + CASE WHEN clarity IS NULL THEN 0 ELSE 1 END
  + CASE WHEN specificity IS NULL THEN 0 ELSE 1 END + CASE WHEN compliance IS NULL THEN 0 ELSE 1 END + CASE WHEN actionability IS NULL THEN 0 ELSE 1 END) > 0
  THEN round((coalesce(completeness, 0) + coalesce(clarity, 0) + coalesce(specificity, 0) + coalesce(compliance, 0) + coalesce(actionability, 0))
   / (CASE WHEN completeness IS NULL THEN 0 ELSE 1 END + CASE WHEN clarity IS NULL THEN 0 ELSE 1 END
  + CASE WHEN specificity IS NULL THEN 0 ELSE 1 END + CASE WHEN compliance IS NULL THEN 0 ELSE 1 END + CASE WHEN actionability IS NULL THEN 0 ELSE 1 END), 2) END AS average_score
  FROM f_evals),
merged AS (SELECT r.*, c.org_unit, c.level, c.posting_date FROM rub r LEFT JOIN f_corpus c ON r.jd_id = c.jd_id)"""
QF = ("f_evals", "f_corpus")


def _merged(spark, sf):
    ev = quality.with_rubric(fx(spark, sf, "f_evals"))
    return quality.merge_metadata(ev, _corpus(spark, sf))


@query(
    "p09_rubric_columns",
    f"WITH {_RUBRIC} SELECT jd_id, completeness, clarity, CAST(specificity AS DOUBLE) AS specificity, compliance, actionability, average_score FROM rub",
    QF,
)
def q_p09(spark, sf):
    # specificity has NULLs: reported as DOUBLE so both engines hand back floats
    r = quality.with_rubric(fx(spark, sf, "f_evals"))
    return r.select("jd_id", "completeness", "clarity", F.col("specificity").cast("double"), "compliance", "actionability", "average_score")


@query(
    "f03_eval_present",
    "SELECT jd_id, completeness FROM f_evals WHERE jd_id IS NOT NULL AND completeness IS NOT NULL",
    ("f_evals",),
)
def q_f03(spark, sf):
    ev = fx(spark, sf, "f_evals")
    raw = ev.select(
        F.col("jd_id"),
        *[F.col(d).cast("string").alias(f"eval_{d}") for d in quality.DIMENSIONS],
        F.when(F.col("is_gold_standard"), "TRUE").otherwise("no").alias("eval_is_gold_standard"),
        F.col("jd_id").cast("bigint").alias("_file_order"),
    )
    return quality.import_csv_evaluations(raw, order_col="_file_order").select("jd_id", "completeness")


@query(
    "f04_gold_flag",
    """SELECT jd_id, upper(coalesce(CASE CAST(jd_id AS BIGINT) % 3 WHEN 0 THEN CASE WHEN is_gold_standard THEN 'TRUE' ELSE 'FALSE' END
  WHEN 1 THEN CASE WHEN is_gold_standard THEN 'true' ELSE 'no' END ELSE CASE WHEN is_gold_standard THEN 'yes' END END, '')) = 'TRUE' AS gold
FROM f_evals""",
    ("f_evals",),
)
def q_f04(spark, sf):
    ev = fx(spark, sf, "f_evals")
    g = F.col("is_gold_standard")
    txt = (
        F.when(F.col("jd_id").cast("bigint") % 3 == 0, F.when(g, "TRUE").otherwise("FALSE"))
        .when(F.col("jd_id").cast("bigint") % 3 == 1, F.when(g, "true").otherwise("no"))
        .otherwise(F.when(g, "yes"))
    )
    return ev.select("jd_id", quality.gold_flag(txt).alias("gold"))


@query(
    "j01_eval_left_meta",
    f"WITH {_RUBRIC} SELECT jd_id, average_score, org_unit, level, posting_date FROM merged",
    QF,
)
def q_j01(spark, sf):
    return _merged(spark, sf).select("jd_id", "average_score", "org_unit", "level", "posting_date")


@query(
    "a10_quality_overall",
    f"""WITH {_RUBRIC} SELECT CAST(count(*) AS BIGINT) AS total_evaluated, avg(completeness) AS mean_completeness, avg(clarity) AS mean_clarity,
  avg(specificity) AS mean_specificity, avg(compliance) AS mean_compliance, avg(actionability) AS mean_actionability,
  avg(average_score) AS mean_average_score, CAST(count(*) FILTER (WHERE coalesce(is_gold_standard, false)) AS BIGINT) AS gold_standard_count,
  array_to_string(list_sort(list(jd_id) FILTER (WHERE coalesce(is_gold_standard, false))), ',') AS gold_standard_ids FROM merged""",
    QF,
)
def q_a10(spark, sf):
    return quality.quality_overall(_merged(spark, sf))


@query(
    "a11_quality_by_org_unit",
    f"WITH {_RUBRIC} SELECT org_unit, avg(average_score) AS mean, CAST(count(average_score) AS BIGINT) AS count FROM merged WHERE org_unit IS NOT NULL GROUP BY 1",
    QF,
)
def q_a11(spark, sf):
    return quality.quality_by_group(_merged(spark, sf), "org_unit")


@query(
    "a11_quality_by_level",
    f"WITH {_RUBRIC} SELECT level, avg(average_score) AS mean, CAST(count(average_score) AS BIGINT) AS count FROM merged WHERE level IS NOT NULL GROUP BY 1",
    QF,
)
def q_a11b(spark, sf):
    return quality.quality_by_group(_merged(spark, sf), "level")


_VALID = """v AS (SELECT *, CAST(TRY_CAST(posting_date AS TIMESTAMP) AS TIMESTAMP) AS d FROM merged
  WHERE TRY_CAST(posting_date AS TIMESTAMP) IS NOT NULL AND average_score IS NOT NULL),
vg AS (SELECT * FROM v WHERE (SELECT count(*) FROM v) >= 5)"""


@query(
    "a12_quality_by_quarter",
    f"""WITH {_RUBRIC}, {_VALID}
SELECT CAST(year(d) AS VARCHAR) || 'Q' || CAST(quarter(d) AS VARCHAR) AS period, round(avg(average_score), 2) AS mean, CAST(count(*) AS BIGINT) AS count
FROM vg GROUP BY 1 HAVING count(*) >= 2""",
    QF,
)
def q_a12(spark, sf):
    return quality.quality_by_period(_merged(spark, sf), "quarter")


@query(
    "a13_quality_by_month",
    f"""WITH {_RUBRIC}, {_VALID},
g AS (SELECT strftime(d, '%Y-%m') AS period, round(avg(average_score), 2) AS mean, CAST(count(*) AS BIGINT) AS count FROM vg GROUP BY 1 HAVING count(*) >= 2)
SELECT * FROM g WHERE (SELECT count(*) FROM g) >= 3""",
    QF,
)
def q_a13(spark, sf):
    return quality.quality_by_period(_merged(spark, sf), "month")


@query(
    "a14_trend_split",
    f"""WITH {_RUBRIC}, {_VALID},
m AS (SELECT quantile_cont(epoch_us(d), 0.5) AS med FROM vg),
s AS (SELECT avg(average_score) FILTER (WHERE epoch_us(d) >= med) AS rm, count(*) FILTER (WHERE epoch_us(d) >= med) AS rc,
             avg(average_score) FILTER (WHERE epoch_us(d) < med) AS om, count(*) FILTER (WHERE epoch_us(d) < med) AS oc FROM vg, m)
SELECT round(rm, 2) AS recent_mean, CAST(rc AS BIGINT) AS recent_count, round(om, 2) AS older_mean, CAST(oc AS BIGINT) AS older_count,
  round(rm - om, 2) AS difference, CASE WHEN rm > om THEN 'improving' WHEN rm < om THEN 'declining' ELSE 'stable' END AS trend
FROM s WHERE rc >= 3 AND oc >= 3""",
    QF,
)
def q_a14(spark, sf):
    return quality.quality_trend(_merged(spark, sf))


@query(
    "a15_date_score_corr",
    f"""WITH {_RUBRIC}, {_VALID},
c AS (SELECT corr(CAST(floor((epoch_us(d) - (SELECT min(epoch_us(d)) FROM vg)) / 86400000000) AS DOUBLE), average_score) AS r FROM vg)
SELECT round(r, 3) AS coefficient, CASE WHEN r > 0.1 THEN 'positive (newer JDs score higher)' WHEN r < -0.1 THEN 'negative (older JDs score higher)'
  ELSE 'no significant correlation' END AS interpretation FROM c WHERE r IS NOT NULL AND NOT isnan(r)""",
    QF,
)
def q_a15(spark, sf):
    return quality.quality_date_correlation(_merged(spark, sf))


@query(
    "a16_date_range",
    f"""WITH {_RUBRIC}, {_VALID}
SELECT strftime(min(d), '%Y-%m-%d') AS earliest, strftime(max(d), '%Y-%m-%d') AS latest,
  CAST(floor((epoch_us(max(d)) - epoch_us(min(d))) / 86400000000) AS BIGINT) AS span_days FROM vg HAVING min(d) IS NOT NULL""",
    QF,
)
def q_a16(spark, sf):
    return quality.quality_date_range(_merged(spark, sf))


@query(
    "a17_score_distribution",
    f"""WITH {_RUBRIC}, long AS ({' UNION ALL '.join(f"SELECT '{d}' AS dimension, CAST({d} AS BIGINT) AS score FROM merged" for d in quality.DIMENSIONS)})
SELECT dimension, score, CAST(count(*) AS BIGINT) AS count FROM long WHERE score IS NOT NULL GROUP BY 1, 2""",
    QF,
)
def q_a17(spark, sf):
    return quality.score_distribution(_merged(spark, sf))


@query(
    "a18_problem_areas",
    f"""WITH {_RUBRIC}, long AS ({' UNION ALL '.join(f"SELECT '{d}' AS dimension, avg({d}) AS mean FROM merged" for d in quality.DIMENSIONS + ['average_score'])})
SELECT dimension, mean FROM long WHERE mean < 3""",
    QF,
)
def q_a18(spark, sf):
    return quality.problem_areas(_merged(spark, sf))


def flagship(spark, sf_dir):
    """Minimum slice: documents -> clean -> filters -> join scores -> quality by group."""
    return quality.quality_by_group(_merged_clean(spark, sf_dir), "org_unit")


def _merged_clean(spark, sf):
    ev = quality.with_rubric(fx(spark, sf, "f_evals"))
    return quality.merge_metadata(ev, _clean(spark, sf))


_ = table  # re-exported for callers that read raw tables
