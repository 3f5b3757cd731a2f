"""Derived inputs built from the driver's tables (see FIXTURES.md).

Each fixture is one SQL text that runs unchanged in Spark SQL and DuckDB.
Spark side: the raw tables are registered as views and the text is run with
``spark.sql``; oracle side: the same text goes into a ``WITH`` clause.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scriptorium.sources.tables import register_tables

FIXTURE_SQL = {
    # F1 corpus
    "f_corpus": """
SELECT CAST(doc_id AS STRING) AS jd_id, text AS jd_text, source AS org_unit, lang AS level,
  concat('Role ', CAST(doc_id % 12 AS STRING)) AS title, concat('fn', CAST(doc_id % 5 AS STRING)) AS function,
  CAST(DATE '2024-01-01' + CAST((doc_id * 7) % 365 AS INT) AS STRING) AS posting_date
FROM documents""",
    # F2 evaluations
    "f_evals": """
SELECT CAST(doc_id AS STRING) AS jd_id, CAST(1 + (doc_id + 2*quality) % 5 AS INT) AS completeness,
  CAST(1 + (doc_id*3 + quality) % 5 AS INT) AS clarity,
  CASE WHEN doc_id % 9 = 0 THEN NULL ELSE CAST(1 + (doc_id*7) % 5 AS INT) END AS specificity,
  CAST(5 - 4*toxic AS INT) AS compliance, CAST(1 + 4*quality AS INT) AS actionability,
  (quality = 1 AND doc_id % 17 = 0) AS is_gold_standard
FROM labels""",
    # F3 record metadata with clusters
    "f_meta": """
SELECT CAST(o_orderkey AS STRING) AS jd_id, o_orderpriority AS title, r_name AS division, n_name AS function,
  c_mktsegment AS level, o_orderdate AS posting_date,
  CAST(CASE WHEN o_orderkey % 11 = 0 THEN -1 ELSE o_custkey % 20 END AS INT) AS cluster,
  CAST(CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_custkey % 12 END AS INT) AS years_min,
  CAST(CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 2 + o_custkey % 15 END AS INT) AS years_preferred
FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    # F4 requirement items
    "f_items": """
SELECT CAST(l_orderkey AS STRING) AS jd_id, CAST(l_linenumber AS INT) AS pos,
  CASE l_linenumber % 7 WHEN 0 THEN 'technical' WHEN 1 THEN 'domain' WHEN 2 THEN 'soft' WHEN 3 THEN 'tools'
    WHEN 4 THEN 'licenses' WHEN 5 THEN 'certifications' ELSE 'languages' END AS category,
  CASE WHEN l_returnflag = 'N' THEN 'required' ELSE 'preferred' END AS kind, p_name AS item
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    # F6 vectors
    "f_vectors": """
SELECT CAST(vec_id AS STRING) AS jd_id, embedding AS features, label FROM embeddings""",
    # F7 raw nested JSON
    "f_raw_json": """
SELECT CAST(o_orderkey AS STRING) AS jd_id,
  concat('{"job_id":"', CAST(o_orderkey AS STRING), '","metadata":{"business_unit":"', n_name, '","grade":"', c_mktsegment,
    '","tags":["', o_orderstatus, '","', o_orderpriority, '"]},"content":{"full_description":',
    CASE WHEN o_orderkey % 13 = 0 THEN 'null' ELSE concat('"', c_name, '"') END, '}',
    CASE WHEN o_orderkey % 50 = 49 THEN '' ELSE '}' END) AS value
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    # F8 sectioned text
    "f_sectioned": """
SELECT CAST(doc_id AS STRING) AS jd_id,
  concat(CASE WHEN doc_id % 3 = 0 THEN concat(substr(text, 1, a), chr(10)) ELSE '' END,
    'Summary:', chr(10), CASE WHEN doc_id % 3 = 0 THEN substr(text, a + 1, a) ELSE substr(text, 1, 2 * a) END, chr(10),
    CASE WHEN doc_id % 2 = 0 THEN concat('Key Responsibilities:', chr(10)) ELSE concat('WHAT WE OFFER', chr(10)) END,
    CASE WHEN doc_id % 7 = 0 THEN concat('perks               benefits', chr(10)) ELSE '' END,
    substr(text, 2 * a + 1, 2 * a), chr(10),
    CASE WHEN doc_id % 5 = 0 THEN '' ELSE concat('Required Qualifications', chr(10)) END,
    substr(text, 4 * a + 1)) AS jd_text
FROM (SELECT doc_id, text, CAST(floor(length(text) / 5) AS INT) AS a FROM documents)""",
    # F9 model responses
    "f_responses": """
SELECT CAST(part.p_partkey AS STRING) AS jd_id,
  concat(CASE WHEN p_partkey % 3 = 0 THEN concat('```json', chr(10)) ELSE '' END,
    CASE WHEN p_partkey % 10 = 7 THEN '{broken' ELSE concat('{"licenses":{"required":["', p_brand,
      '"],"preferred":[]},"experience":{"years_min":', CAST(p_size AS STRING), '}}') END,
    CASE WHEN p_partkey % 3 = 0 THEN concat(chr(10), '```') ELSE '' END) AS response
FROM part""",
    # F10 skill mapping
    "f_skill_map": """
SELECT DISTINCT p_name AS original,
  CASE WHEN p_name LIKE 'small %' OR p_name LIKE 'large %' THEN concat('sized ', substr(p_name, 7)) ELSE p_name END AS standardized
FROM part""",
    # F11 markup
    "f_markup": """
SELECT page_id, html FROM pages""",
}
# F5 assignments are (jd_id, cluster) of F3.
FIXTURE_SQL["f_assign"] = "SELECT jd_id, cluster FROM f_meta"
FIXTURE_DEPS = {"f_assign": ["f_meta"]}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    register_tables(spark, sf_dir)
    for dep in FIXTURE_DEPS.get(name, []):
        spark.sql(FIXTURE_SQL[dep]).createOrReplaceTempView(dep)
    return spark.sql(FIXTURE_SQL[name])


def with_fixtures(names, body: str) -> str:
    """Oracle text: the fixtures a query needs as CTEs in front of ``body``."""
    ordered = []
    for n in names:
        for dep in FIXTURE_DEPS.get(n, []):
            if dep not in ordered:
                ordered.append(dep)
        if n not in ordered:
            ordered.append(n)
    body = body.strip()
    if not ordered:
        return body
    ctes = ",\n".join(f"{n} AS ({FIXTURE_SQL[n]})" for n in ordered)
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
