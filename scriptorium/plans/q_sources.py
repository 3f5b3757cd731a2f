"""Checked queries: raw JSON records, mapping, flattening and schema discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions.text import path_depth, path_leaf
from scriptorium.operators import discovery as D
from scriptorium.plans.registry import fx, query
from scriptorium.sources import records as R

J = ("f_raw_json",)


def _raw(spark, sf):
    return fx(spark, sf, "f_raw_json")


def _records(spark, sf):
    return R.explode_records(_raw(spark, sf))


@query("s02_record_explode", "SELECT jd_id, json_extract_string(value, '$.job_id') AS job_id FROM f_raw_json WHERE json_valid(value)", J)
def q_s02(spark, sf):
    return _records(spark, sf).select("jd_id", F.try_variant_get("record", "$.job_id", "string").alias("job_id"))


@query("s03_malformed_skip", "SELECT jd_id FROM f_raw_json WHERE NOT json_valid(value)", J)
def q_s03(spark, sf):
    return R.malformed(_raw(spark, sf)).select("jd_id")


@query("s07_drop_system_fields", "SELECT jd_id, title FROM f_meta", ("f_meta",))
def q_s07(spark, sf):
    m = fx(spark, sf, "f_meta").select("jd_id", "title")
    with_sys = m.select("*", *[F.concat(F.lit(c), F.col("jd_id")).alias(c) for c in R.SYSTEM_FIELDS])
    return R.drop_system_fields(with_sys)


@query("s08_source_count", "SELECT CAST(count(*) AS BIGINT) AS records FROM f_raw_json WHERE json_valid(value)", J)
def q_s08(spark, sf):
    return _records(spark, sf).agg(F.count(F.lit(1)).cast("bigint").alias("records"))


@query("a01_record_count", "SELECT CAST(count(*) AS BIGINT) AS n FROM f_meta", ("f_meta",))
def q_a01(spark, sf):
    return fx(spark, sf, "f_meta").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@query(
    "s09_source_sample",
    "SELECT jd_id, json_extract_string(value, '$.metadata.grade') AS grade FROM f_raw_json WHERE json_valid(value) ORDER BY CAST(jd_id AS BIGINT) LIMIT 5",
    J,
)
def q_s09(spark, sf):
    r = _records(spark, sf).withColumn("_k", F.col("jd_id").cast("bigint"))
    return R.source_sample(r, 5, "_k").select("jd_id", F.try_variant_get("record", "$.metadata.grade", "string").alias("grade"))


@query(
    "s15_vector_scan",
    "SELECT jd_id, CAST(len(features) AS BIGINT) AS dims, label FROM f_vectors",
    ("f_vectors",),
)
def q_s15(spark, sf):
    return fx(spark, sf, "f_vectors").select("jd_id", F.size("features").cast("bigint").alias("dims"), "label")


_MAPPING = {
    "jd_id": "job_id",
    "jd_text": "content.full_description",
    "org_unit": "metadata.business_unit",
    "level": "metadata.grade",
    "title": None,
    "posting_date": "metadata.posted",
}


@query(
    "p01_map_fields",
    """SELECT json_extract_string(value, '$.job_id') AS jd_id, json_extract_string(value, '$.content.full_description') AS jd_text,
  json_extract_string(value, '$.metadata.business_unit') AS org_unit, json_extract_string(value, '$.metadata.grade') AS level,
  json_extract_string(value, '$.metadata.posted') AS posting_date FROM f_raw_json WHERE json_valid(value)""",
    J,
)
def q_p01(spark, sf):
    return D.map_fields(_records(spark, sf), _MAPPING).select("jd_id", "jd_text", "org_unit", "level", "posting_date")


@query("s13_full_load", "SELECT count(*) AS n, count(json_extract_string(value, '$.content.full_description')) AS with_text FROM f_raw_json WHERE json_valid(value)", J)
def q_s13(spark, sf):
    m = D.map_fields(_records(spark, sf), _MAPPING)
    return m.agg(F.count(F.lit(1)).alias("n"), F.count("jd_text").alias("with_text"))


@query(
    "p02_dotted_path_get",
    """SELECT jd_id, json_extract_string(value, '$.metadata.tags[1]') AS tag_1, json_extract_string(value, '$.metadata.tags[5]') AS tag_5,
  json_extract_string(value, '$.metadata.nope') AS missing FROM f_raw_json WHERE json_valid(value)""",
    J,
)
def q_p02(spark, sf):
    r = F.col("record")
    return _records(spark, sf).select(
        "jd_id", D.path_get(r, "metadata.tags.1").alias("tag_1"), D.path_get(r, "metadata.tags.5").alias("tag_5"),
        D.path_get(r, "metadata.nope").alias("missing"),
    )


@query(
    "p03_flatten",
    """SELECT json_extract_string(value, '$.job_id') AS job_id, json_extract_string(value, '$.metadata.business_unit') AS "metadata.business_unit",
  json_extract_string(value, '$.metadata.grade') AS "metadata.grade",
  array_to_string(CAST(json_extract(value, '$.metadata.tags') AS VARCHAR[]), ',') AS "metadata.tags",
  json_extract_string(value, '$.content.full_description') AS "content.full_description"
FROM f_raw_json WHERE json_valid(value)""",
    J,
)
def q_p03(spark, sf):
    recs = _records(spark, sf)
    # the struct type of the records comes from one aggregate over all of them
    ddl = recs.select(F.schema_of_variant_agg("record")).first()[0].replace("OBJECT<", "STRUCT<")
    typed = recs.select(F.try_variant_get("record", "$", ddl).alias("r")).select("r.*")
    flat = D.flatten(typed)
    return flat.withColumn("metadata.tags", F.array_join(F.col("`metadata.tags`"), ","))


@query(
    "p07_id_to_string",
    """SELECT CAST(o.o_orderkey AS VARCHAR) AS jd_id, CAST(count(*) AS BIGINT) AS n_items FROM orders o JOIN f_items i ON CAST(o.o_orderkey AS VARCHAR) = i.jd_id
GROUP BY 1""",
    ("f_items",),
)
def q_p07(spark, sf):
    from scriptorium.sources.tables import table

    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("jd_id"))
    return o.join(fx(spark, sf, "f_items"), "jd_id").groupBy("jd_id").agg(F.count(F.lit(1)).cast("bigint").alias("n_items"))


_SUMMARY = """j AS (SELECT CAST(value AS JSON) AS j FROM f_raw_json WHERE json_valid(value)),
l0 AS (SELECT k AS path, json_extract(j, '$."' || k || '"') AS v FROM (SELECT j, unnest(json_keys(j)) AS k FROM j)),
l1 AS (SELECT path || '.' || k AS path, json_extract(v, '$."' || k || '"') AS v FROM (SELECT path, v, unnest(json_keys(v)) AS k FROM l0 WHERE json_type(v) = 'OBJECT')),
l2 AS (SELECT path || '.' || k AS path, json_extract(v, '$."' || k || '"') AS v FROM (SELECT path, v, unnest(json_keys(v)) AS k FROM l1 WHERE json_type(v) = 'OBJECT')),
e AS (SELECT path, v, CASE json_type(v) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean'
        WHEN 'BIGINT' THEN 'integer' WHEN 'UBIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'number' WHEN 'NULL' THEN 'null' END AS type
      FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2)),
s AS (SELECT path, CAST(count(*) AS BIGINT) AS count, CAST(count(*) FILTER (WHERE type = 'null') AS BIGINT) AS null_count,
  round(count(*) FILTER (WHERE type = 'null') / count(*), 3) AS null_rate, array_to_string(list_sort(list_distinct(list(type))), ',') AS types,
  CAST(min(length(json_extract_string(v, '$'))) FILTER (WHERE type = 'string') AS BIGINT) AS str_min_len,
  CAST(max(length(json_extract_string(v, '$'))) FILTER (WHERE type = 'string') AS BIGINT) AS str_max_len,
  round(avg(length(json_extract_string(v, '$'))) FILTER (WHERE type = 'string'), 1) AS str_avg_len,
  CAST(min(json_array_length(v)) FILTER (WHERE type = 'array') AS BIGINT) AS arr_min_len,
  CAST(max(json_array_length(v)) FILTER (WHERE type = 'array') AS BIGINT) AS arr_max_len,
  round(avg(json_array_length(v)) FILTER (WHERE type = 'array'), 1) AS arr_avg_len,
  array_to_string(list_sort(list_distinct(flatten(list(json_keys(v)) FILTER (WHERE type = 'object')))), ',') AS nested_keys
FROM e GROUP BY path)"""


def _summary(spark, sf):
    return D.schema_summary(R.explode_records(R.dealt(_raw(spark, sf).select("value"))), rid_col="rid")


_SCOLS = ["path", "count", "null_count", "null_rate", "types", "str_min_len", "str_max_len", "str_avg_len", "arr_min_len", "arr_max_len", "arr_avg_len", "nested_keys"]


@query("a02_schema_summary", f"WITH {_SUMMARY} SELECT path, count, null_count, null_rate, types, CAST(str_min_len AS DOUBLE) AS str_min_len, CAST(str_max_len AS DOUBLE) AS str_max_len, str_avg_len, CAST(arr_min_len AS DOUBLE) AS arr_min_len, CAST(arr_max_len AS DOUBLE) AS arr_max_len, arr_avg_len, coalesce(nested_keys, '') AS nested_keys FROM s", J)
def q_a02(spark, sf):
    s = _summary(spark, sf)
    # length columns are NULL for paths of other types: reported as DOUBLE in both engines
    return s.select(
        "path", "count", "null_count", "null_rate", "types",
        *[F.col(c).cast("double").alias(c) for c in ["str_min_len", "str_max_len"]], "str_avg_len",
        *[F.col(c).cast("double").alias(c) for c in ["arr_min_len", "arr_max_len"]], "arr_avg_len",
        F.coalesce("nested_keys", F.lit("")).alias("nested_keys"),
    )


@query("f14_type_filter", f"WITH {_SUMMARY} SELECT path FROM s WHERE list_contains(string_split(types, ','), 'string')", J)
def q_f14(spark, sf):
    return D.field_paths(_summary(spark, sf), "string")


@query("f11_text_field_candidates", f"WITH {_SUMMARY} SELECT path, str_avg_len AS avg_length FROM s WHERE list_contains(string_split(types, ','), 'string') AND str_avg_len >= 10", J)
def q_f11(spark, sf):
    return D.text_field_candidates(_summary(spark, sf), 10).select("path", "avg_length")


def _like_any(words):
    return " OR ".join(f"contains(lower(path), '{w}')" for w in words)


@query("f12_id_field_candidates", f"WITH {_SUMMARY} SELECT path FROM s WHERE {_like_any(D.ID_INDICATORS)}", J)
def q_f12(spark, sf):
    return D.id_field_candidates(_summary(spark, sf)).select("path")


@query("f13_metadata_candidates", f"WITH {_SUMMARY} SELECT path FROM s WHERE {_like_any(D.METADATA_INDICATORS)}", J)
def q_f13(spark, sf):
    return D.metadata_candidates(_summary(spark, sf)).select("path")


@query(
    "a03_suggest_mapping",
    f"""WITH {_SUMMARY},
c AS (SELECT 'jd_text' AS standard_field, path, -str_avg_len AS o FROM s WHERE list_contains(string_split(types, ','), 'string') AND str_avg_len >= 100
  UNION ALL SELECT 'jd_id', path, 0 FROM s WHERE {_like_any(D.ID_INDICATORS)}
  {''.join(f" UNION ALL SELECT '{f}', path, 0 FROM s WHERE ({_like_any(D.METADATA_INDICATORS)}) AND ({_like_any(inds)})" for f, inds in D.STANDARD_FIELD_INDICATORS.items())})
SELECT standard_field, path FROM (SELECT *, row_number() OVER (PARTITION BY standard_field ORDER BY o, path) AS r FROM c) WHERE r = 1""",
    J,
)
def q_a03(spark, sf):
    return D.suggest_mapping(_summary(spark, sf))


@query(
    "t16_path_depth_name",
    f"""WITH {_SUMMARY} SELECT path, CAST((length(path) - length(replace(path, '.', ''))) + (length(path) - length(replace(path, '[', ''))) AS BIGINT) AS depth,
  string_split(path, '.')[-1] AS leaf FROM s""",
    J,
)
def q_t16(spark, sf):
    return _summary(spark, sf).select("path", path_depth("path").cast("bigint").alias("depth"), path_leaf("path").alias("leaf"))


@query(
    "s12_chunked_scan",
    """SELECT jd_id, CAST((row_number() OVER (ORDER BY jd_id) - 1) // 1000 AS BIGINT) AS chunk FROM f_meta""",
    ("f_meta",),
)
def q_s12(spark, sf):
    """Chunks of 1,000 records by id, the last one partial."""
    return R.record_chunks(fx(spark, sf, "f_meta").select("jd_id"), ["jd_id"], 1000)
