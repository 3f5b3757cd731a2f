"""Checked queries: model responses (F9), requirement records and texts (F3 + F4), naming."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import naming as N
from scriptorium.operators import requirements as Q
from scriptorium.plans.registry import fx, query

R9 = ("f_responses",)
MI = ("f_meta", "f_items")

_STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_FENCE = _STRIP.format(x="regexp_replace(regexp_replace(regexp_replace(" + _STRIP.format(x="response") + ", '^```json', ''), '^```', ''), '```$', '')")


def _parsed(spark, sf):
    return Q.parse_response(fx(spark, sf, "f_responses"))


@query("t08_strip_code_fence", f"SELECT jd_id, {_FENCE} AS body FROM f_responses", R9)
def q_t08(spark, sf):
    return fx(spark, sf, "f_responses").select("jd_id", T.strip_code_fence("response").alias("body"))


@query(
    "c05_json_parse",
    f"""SELECT jd_id, json_valid(b) AS extraction_success,
  CASE WHEN json_valid(b) THEN array_to_string(CAST(json_extract(b, '$.licenses.required') AS VARCHAR[]), ',') END AS licenses_required,
  CAST(CASE WHEN json_valid(b) THEN json_extract(b, '$.experience.years_min') END AS DOUBLE) AS years_min
FROM (SELECT jd_id, {_FENCE} AS b FROM f_responses)""",
    R9,
)
def q_c05(spark, sf):
    p = _parsed(spark, sf)
    e = F.col("extraction")
    return p.select(
        "jd_id", "extraction_success",
        F.when(F.col("extraction_success"), F.array_join(e["licenses"]["required"], ",")).alias("licenses_required"),
        e["experience"]["years_min"].cast("double").alias("years_min"),
    )


@query(
    "p08_reshape_extraction",
    f"""SELECT jd_id, CAST(0 AS BIGINT) AS n_cert_required, CAST(len(CAST(json_extract(b, '$.licenses.preferred') AS VARCHAR[])) AS BIGINT) AS n_license_preferred,
  CAST(0 AS BIGINT) AS n_tools
FROM (SELECT jd_id, {_FENCE} AS b FROM f_responses) WHERE json_valid(b)""",
    R9,
)
def q_p08(spark, sf):
    e = F.col("extraction")
    return _parsed(spark, sf).where("extraction_success").select(
        "jd_id",
        F.size(e["certifications"]["required"]).cast("bigint").alias("n_cert_required"),
        F.size(e["licenses"]["preferred"]).cast("bigint").alias("n_license_preferred"),
        F.size(F.concat(e["tools"]["required"], e["tools"]["preferred"])).cast("bigint").alias("n_tools"),
    )


@query(
    "c06_json_serialize",
    f"""SELECT jd_id, CAST(json_object('jd_id', jd_id, 'licenses', CAST(json_extract(b, '$.licenses.required') AS VARCHAR[])) AS VARCHAR) AS json
FROM (SELECT jd_id, {_FENCE} AS b FROM f_responses) WHERE json_valid(b)""",
    R9,
)
def q_c06(spark, sf):
    p = _parsed(spark, sf).where("extraction_success")
    return p.select("jd_id", Q.to_json_text(F.struct(F.col("jd_id"), F.col("extraction.licenses.required").alias("licenses"))).alias("json"))


@query("f07_success_filter", f"SELECT jd_id FROM (SELECT jd_id, {_FENCE} AS b FROM f_responses) WHERE json_valid(b)", R9)
def q_f07(spark, sf):
    return _parsed(spark, sf).where("extraction_success").select("jd_id")


@query(
    "r04_extract_batch",
    f"""WITH p AS (SELECT jd_id, json_valid({_FENCE}) AS ok FROM f_responses)
SELECT ok AS extraction_success, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY 1""",
    R9,
)
def q_r04(spark, sf):
    done = _parsed(spark, sf).where("extraction_success")
    todo = fx(spark, sf, "f_responses")
    res = Q.extract_batch(todo, Q.parse_response, done)
    return res.groupBy("extraction_success").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@query(
    "j07_resume_anti",
    f"SELECT jd_id FROM (SELECT jd_id, {_FENCE} AS b FROM f_responses) WHERE NOT json_valid(b)",
    R9,
)
def q_j07(spark, sf):
    done = _parsed(spark, sf).where("extraction_success")
    return fx(spark, sf, "f_responses").join(done.select("jd_id"), "jd_id", "left_anti").select("jd_id")


# ---------------------------------------------------------------- records from items

def _records(spark, sf):
    years = fx(spark, sf, "f_meta").select("jd_id", "years_min", "years_preferred")
    return Q.records_from_items(fx(spark, sf, "f_items"), years)


_LISTS = """il AS (SELECT jd_id, category,
   list(item ORDER BY pos, item) FILTER (WHERE kind = 'required') AS req, list(item ORDER BY pos, item) FILTER (WHERE kind = 'preferred') AS pref
   FROM f_items GROUP BY 1, 2),
cat AS (SELECT jd_id, category, list_concat(coalesce(req, []), coalesce(pref, [])) AS items FROM il),
docs AS (SELECT DISTINCT jd_id FROM f_items),
w AS (SELECT d.jd_id,
  (SELECT items FROM cat c WHERE c.jd_id = d.jd_id AND c.category = 'licenses') AS lic,
  (SELECT items FROM cat c WHERE c.jd_id = d.jd_id AND c.category = 'certifications') AS cer,
  list_concat(coalesce((SELECT items FROM cat c WHERE c.jd_id = d.jd_id AND c.category = 'technical'), []),
              coalesce((SELECT items FROM cat c WHERE c.jd_id = d.jd_id AND c.category = 'domain'), []),
              coalesce((SELECT items FROM cat c WHERE c.jd_id = d.jd_id AND c.category = 'soft'), [])) AS sk,
  (SELECT items FROM cat c WHERE c.jd_id = d.jd_id AND c.category = 'tools') AS tl,
  m.years_min, m.division, m.function
  FROM docs d LEFT JOIN f_meta m ON d.jd_id = m.jd_id),
txt AS (SELECT jd_id, division, function, coalesce(nullif(concat_ws('; ',
    CASE WHEN len(lic) > 0 THEN 'Licenses: ' || array_to_string(lic, ', ') END,
    CASE WHEN len(cer) > 0 THEN 'Certifications: ' || array_to_string(cer, ', ') END,
    CASE WHEN len(sk) > 0 THEN 'Skills: ' || array_to_string(sk, ', ') END,
    CASE WHEN len(tl) > 0 THEN 'Tools: ' || array_to_string(tl, ', ') END,
    CASE WHEN coalesce(years_min, 0) <> 0 THEN 'Experience: ' || CAST(years_min AS VARCHAR) || '+ years' END), ''), 'No requirements extracted') AS text
  FROM w)"""


@query("t09_requirements_text", f"WITH {_LISTS} SELECT jd_id, text FROM txt", MI)
def q_t09(spark, sf):
    return _records(spark, sf).select("jd_id", Q.requirements_text(F.col("extraction")).alias("text"))


@query(
    "t10_contextual_text",
    f"""WITH {_LISTS} SELECT jd_id, CASE WHEN concat_ws(' ', CASE WHEN coalesce(division, '') <> '' THEN '[division: ' || division || ']' END,
  CASE WHEN coalesce(function, '') <> '' THEN '[function: ' || function || ']' END) = '' THEN text
  ELSE concat_ws(' ', CASE WHEN coalesce(division, '') <> '' THEN '[division: ' || division || ']' END,
  CASE WHEN coalesce(function, '') <> '' THEN '[function: ' || function || ']' END) || ' ' || text END AS text FROM txt""",
    MI,
)
def q_t10(spark, sf):
    r = _records(spark, sf).join(fx(spark, sf, "f_meta").select("jd_id", "division", "function"), "jd_id", "left")
    base = Q.requirements_text(F.col("extraction"))
    return r.select("jd_id", Q.contextual_text(base, {"division": F.col("division"), "function": F.col("function")}).alias("text"))


@query(
    "r03_extract_years",
    f"WITH {_LISTS} SELECT jd_id, CAST(years_min AS BIGINT) AS years FROM w WHERE coalesce(years_min, 0) <> 0",
    MI,
)
def q_r03(spark, sf):
    t = _records(spark, sf).select("jd_id", Q.requirements_text(F.col("extraction")).alias("text"))
    return t.select("jd_id", Q.extract_years(F.col("text")).cast("bigint").alias("years")).where(F.col("years").isNotNull())


_GRAMS = """g AS (SELECT jd_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}#+]+'), lambda x: x <> '') AS w FROM txt),
ng AS (SELECT DISTINCT jd_id, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT jd_id, w, unnest(range(1, len(w) + 1)) AS i FROM g) x,
  (VALUES (1), (2), (3)) t(n) WHERE i + n - 1 <= len(w)),
dict AS (SELECT DISTINCT lower(item) AS gram, item, category FROM f_items)"""


@query(
    "r01_extract_requirements",
    f"WITH {_LISTS}, {_GRAMS} SELECT DISTINCT ng.jd_id, dict.category, 'required' AS kind, dict.item FROM ng JOIN dict ON ng.gram = dict.gram",
    MI,
)
def q_r01(spark, sf):
    t = _records(spark, sf).select("jd_id", Q.requirements_text(F.col("extraction")).alias("text"))
    d = fx(spark, sf, "f_items").select(F.col("item").alias("term"), F.col("item").alias("canonical"), "category").distinct()
    return Q.extract_requirements(t, d)


@query(
    "r02_extract_education",
    """SELECT jd_id, concat_ws(',', CASE WHEN regexp_matches(jd_text, '(?i)\\b(ph\\.?d|doctorate|doctoral)\\b') THEN 'phd' END,
  CASE WHEN regexp_matches(jd_text, '(?i)\\b(master''?s?|msc|mba|m\\.s\\.)\\b') THEN 'masters' END,
  CASE WHEN regexp_matches(jd_text, '(?i)\\b(bachelor''?s?|bsc|b\\.s\\.|undergraduate degree)\\b') THEN 'bachelors' END,
  CASE WHEN regexp_matches(jd_text, '(?i)\\bassociate''?s? degree\\b') THEN 'associate' END,
  CASE WHEN regexp_matches(jd_text, '(?i)\\b(high school|secondary school|ged)\\b') THEN 'high_school' END) AS levels
FROM f_corpus""",
    ("f_corpus",),
)
def q_r02(spark, sf):
    return fx(spark, sf, "f_corpus").select("jd_id", F.array_join(Q.extract_education(F.col("jd_text")), ",").alias("levels"))


_CATS = ["licenses", "certifications", "tools", "languages", "technical", "domain", "soft"]


@query(
    "a42_items_per_doc",
    """WITH c AS (SELECT jd_id, """
    + ", ".join(f"count(*) FILTER (WHERE category = '{c}') AS n_{c}" for c in _CATS)
    + """ FROM f_items GROUP BY 1)
SELECT jd_id, """
    + ", ".join(f"CAST(n_{c} AS BIGINT) AS n_{c}" for c in _CATS)
    + """, CAST(n_technical + n_domain + n_soft AS BIGINT) AS total_skills,
  CAST(""" + " + ".join(f"n_{c}" for c in _CATS) + """ + n_technical + n_domain + n_soft AS BIGINT) AS total_items,
  CAST(""" + " + ".join(f"n_{c}" for c in _CATS) + """ AS BIGINT) AS total_items_distinct_categories FROM c""",
    ("f_items",),
)
def q_a42(spark, sf):
    return Q.items_per_doc(Q.records_from_items(fx(spark, sf, "f_items")))


@query(
    "a43_top_items",
    """SELECT category, item, CAST(count AS BIGINT) AS count, CAST(rank AS INT) AS rank FROM (
  SELECT category, item, count(*) AS count, row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, item) AS rank FROM f_items GROUP BY 1, 2) WHERE rank <= 15""",
    ("f_items",),
)
def q_a43(spark, sf):
    return Q.top_items(fx(spark, sf, "f_items"))


@query(
    "a44_required_vs_preferred",
    "SELECT category, CAST(count(*) FILTER (WHERE kind = 'required') AS BIGINT) AS required, CAST(count(*) FILTER (WHERE kind = 'preferred') AS BIGINT) AS preferred FROM f_items GROUP BY 1",
    ("f_items",),
)
def q_a44(spark, sf):
    return Q.required_vs_preferred(fx(spark, sf, "f_items"))


@query(
    "a45_empty_rate",
    """WITH c AS (SELECT jd_id, """
    + ", ".join(f"count(*) FILTER (WHERE category = '{c}') AS n_{c}" for c in _CATS)
    + """ FROM f_items GROUP BY 1)
"""
    + " UNION ALL ".join(f"SELECT '{c}' AS category, round(100 * avg(CASE WHEN n_{c} = 0 THEN 1 ELSE 0 END), 1) AS empty_pct FROM c" for c in _CATS)
    + " UNION ALL SELECT 'skills', round(100 * avg(CASE WHEN n_technical + n_domain + n_soft = 0 THEN 1 ELSE 0 END), 1) FROM c",
    ("f_items",),
)
def q_a45(spark, sf):
    return Q.empty_rate(Q.records_from_items(fx(spark, sf, "f_items")))


@query(
    "a46_extraction_summary",
    """WITH d AS (SELECT m.jd_id, EXISTS (SELECT 1 FROM f_items i WHERE i.jd_id = m.jd_id) AS ok FROM f_meta m)
SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS successful,
  round(100.0 * count(*) FILTER (WHERE ok) / count(*), 1) AS success_rate,
  round((SELECT count(*) FROM f_items WHERE jd_id IN (SELECT jd_id FROM d WHERE ok)) / count(*) FILTER (WHERE ok), 2) AS avg_items_per_doc,
  (SELECT CAST(count(DISTINCT item) AS BIGINT) FROM f_items WHERE jd_id IN (SELECT jd_id FROM d WHERE ok)) AS distinct_items FROM d""",
    MI,
)
def q_a46(spark, sf):
    items = fx(spark, sf, "f_items")
    rec = Q.records_from_items(items)
    allr = fx(spark, sf, "f_meta").select("jd_id").join(rec, "jd_id", "left").select(
        "jd_id", F.coalesce("extraction_success", F.lit(False)).alias("extraction_success")
    )
    return Q.extraction_summary(allr, items)


@query(
    "c01_array_concat",
    "SELECT jd_id, category, CAST(count(*) AS BIGINT) AS n FROM f_items GROUP BY 1, 2",
    ("f_items",),
)
def q_c01(spark, sf):
    r = Q.records_from_items(fx(spark, sf, "f_items"))
    return Q.items_of(r).groupBy("jd_id", "category").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@query(
    "c02_array_slice_join",
    """WITH il AS (SELECT jd_id, list(item ORDER BY pos, item) FILTER (WHERE kind = 'required') AS req,
   list(item ORDER BY pos, item) FILTER (WHERE kind = 'preferred') AS pref FROM f_items WHERE category = 'technical' GROUP BY 1)
SELECT jd_id, array_to_string(list_concat(coalesce(req, []), coalesce(pref, []))[1:3], ', ') AS first_items FROM il""",
    ("f_items",),
)
def q_c02(spark, sf):
    r = Q.records_from_items(fx(spark, sf, "f_items").where(F.col("category") == "technical"))
    t = F.col("extraction.skills.technical")
    return r.select("jd_id", F.array_join(F.slice(F.concat(t["required"], t["preferred"]), 1, 3), ", ").alias("first_items"))


# ---------------------------------------------------------------- naming

@query(
    "a49_mapping_groups",
    "SELECT standardized, CAST(count(*) AS BIGINT) AS n_originals, array_to_string(list_sort(list(original)), ', ') AS originals FROM f_skill_map GROUP BY 1 HAVING count(*) > 1",
    ("f_skill_map",),
)
def q_a49(spark, sf):
    return N.mapping_groups(fx(spark, sf, "f_skill_map"))


@query(
    "a49_mapping_counts",
    "SELECT CAST(count(*) FILTER (WHERE original <> standardized) AS BIGINT) AS changed, CAST(count(*) FILTER (WHERE original = standardized) AS BIGINT) AS unchanged FROM f_skill_map",
    ("f_skill_map",),
)
def q_a49b(spark, sf):
    return N.mapping_counts(fx(spark, sf, "f_skill_map"))


@query(
    "a50_standardize_frequencies",
    """WITH an AS (SELECT jd_id, cluster FROM f_meta WHERE cluster <> -1),
mc AS (SELECT x.cluster, count(*) AS mcount FROM an x WHERE x.jd_id IN (SELECT jd_id FROM f_items) GROUP BY 1),
fr AS (SELECT x.cluster, i.category, i.kind, i.item, count(*) / max(mc.mcount) AS freq FROM an x JOIN f_items i ON x.jd_id = i.jd_id
       JOIN mc ON x.cluster = mc.cluster GROUP BY 1, 2, 3, 4)
SELECT cluster, category, kind, coalesce(s.standardized, fr.item) AS item, max(freq) AS freq FROM fr LEFT JOIN f_skill_map s ON fr.item = s.original GROUP BY 1, 2, 3, 4""",
    ("f_meta", "f_items", "f_skill_map"),
)
def q_a50(spark, sf):
    from scriptorium.operators import archetypes as A

    a = A.exclude_noise(fx(spark, sf, "f_meta").select("jd_id", "cluster"))
    f = A.item_frequency(a, fx(spark, sf, "f_items")).select("cluster", "category", "kind", "item", "freq")
    return N.standardize_frequencies(f, fx(spark, sf, "f_skill_map"))


@query(
    "r06_standardize_items",
    """WITH c AS (SELECT item, count(*) AS n, trim(regexp_replace(lower(item), '\\s+', ' ', 'g')) AS k FROM f_items GROUP BY 1),
b AS (SELECT k, item AS best FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, item) AS r FROM c) WHERE r = 1)
SELECT c.item AS original, b.best AS standardized FROM c JOIN b ON c.k = b.k""",
    ("f_items",),
)
def q_r06(spark, sf):
    return N.standardize_items(fx(spark, sf, "f_items"))


@query(
    "t07_slugify",
    "SELECT DISTINCT title, trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM f_meta",
    ("f_meta",),
)
def q_t07(spark, sf):
    return fx(spark, sf, "f_meta").select("title").distinct().select("title", T.slugify("title").alias("slug"))


@query(
    "t14_cluster_label",
    "SELECT DISTINCT cluster, CASE WHEN cluster = -2 THEN 'Unmatched' WHEN cluster = -1 THEN 'Noise' ELSE 'Cluster ' || CAST(cluster AS VARCHAR) END AS label FROM f_meta",
    ("f_meta",),
)
def q_t14(spark, sf):
    return fx(spark, sf, "f_meta").select("cluster").distinct().select("cluster", T.cluster_label("cluster").alias("label"))


@query(
    "t15_word_split",
    "SELECT word, CAST(count(*) AS BIGINT) AS count FROM (SELECT unnest(regexp_split_to_array(trim(title), '\\s+')) AS word FROM f_meta) GROUP BY 1",
    ("f_meta",),
)
def q_t15(spark, sf):
    m = fx(spark, sf, "f_meta")
    return m.select(F.explode(T.word_split("title")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).cast("bigint").alias("count"))


def _titles(spark, sf):
    from scriptorium.operators import archetypes as A

    a = A.exclude_noise(fx(spark, sf, "f_meta").select("jd_id", "cluster"))
    return A.representative_titles(a, fx(spark, sf, "f_meta").drop("cluster"), fx(spark, sf, "f_items"))


# Names from the top titles, as CTEs.
NAMED_SQL = """an AS (SELECT jd_id, cluster FROM f_meta WHERE cluster <> -1 AND jd_id IN (SELECT jd_id FROM f_items)),
t AS (SELECT an.cluster, f_meta.title, row_number() OVER (PARTITION BY an.cluster ORDER BY count(*) DESC, f_meta.title) AS r FROM an JOIN f_meta ON an.jd_id = f_meta.jd_id GROUP BY 1, 2),
w AS (SELECT cluster, list(x ORDER BY r, k) AS words FROM (
  SELECT cluster, r, k, x FROM (SELECT cluster, r, unnest(regexp_split_to_array(trim(title), '\\s+')) AS x, unnest(range(1, len(regexp_split_to_array(trim(title), '\\s+')) + 1)) AS k FROM t WHERE r <= 3))
  WHERE length(x) > 3 AND regexp_matches(x, '^\\p{Lu}') GROUP BY 1),
c AS (SELECT DISTINCT cluster FROM an),
named AS (SELECT c.cluster, coalesce(nullif(array_to_string(w.words[1:3], ' '), ''), 'Cluster ' || CAST(c.cluster AS VARCHAR)) AS archetype_name
FROM c LEFT JOIN w ON c.cluster = w.cluster)"""


@query(
    "r07_name_archetypes",
    f"""WITH {NAMED_SQL},
s AS (SELECT cluster, archetype_name, trim(regexp_replace(lower(archetype_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM named),
r AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY cluster) AS k FROM s)
SELECT cluster, archetype_name, CASE WHEN k = 1 THEN slug ELSE slug || '-' || CAST(k AS VARCHAR) END AS archetype_id FROM r""",
    ("f_meta", "f_items"),
)
def q_r07(spark, sf):
    return N.name_archetypes(_titles(spark, sf))


@query(
    "a48_word_frequency",
    f"""WITH {NAMED_SQL}
SELECT word, CAST(count(*) AS BIGINT) AS count FROM (SELECT unnest(regexp_split_to_array(trim(archetype_name), '\\s+')) AS word FROM named)
WHERE word <> '' GROUP BY word ORDER BY count DESC, word LIMIT 20""",
    ("f_meta", "f_items"),
)
def q_a48(spark, sf):
    return N.word_frequency(N.name_archetypes(_titles(spark, sf)))


@query("r08_naming_features")
def q_r08(spark, sf):
    from scriptorium.operators import archetypes as A

    a = A.exclude_noise(fx(spark, sf, "f_meta").select("jd_id", "cluster"))
    items = fx(spark, sf, "f_items")
    meta = fx(spark, sf, "f_meta").drop("cluster")
    return N.naming_features(A.item_frequency(a, items), _titles(spark, sf), A.field_distribution(a, meta, items))


@query(
    "t13_fallback_name",
    f"WITH {NAMED_SQL} SELECT cluster, archetype_name FROM named",
    MI,
)
def q_t13(spark, sf):
    return N.name_archetypes(_titles(spark, sf)).select("cluster", "archetype_name")
