"""Sink queries: write under the shared checkpoint folder, read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from scriptorium.functions.numeric import rnd

from scriptorium.operators import archetypes as A
from scriptorium.operators import quality, sampling
from scriptorium.plans.registry import fx, query
from scriptorium.session import scratch_path
from scriptorium.sources.records import read_evaluations, write_table

EVAL_COLUMNS = [
    f"eval_{d}{s}" for d in ["completeness", "clarity", "specificity", "compliance", "actionability", "overall_score"] for s in ("", "_notes")
]
EVAL_COLUMNS = [c.replace("overall_score_notes", "overall_notes") for c in EVAL_COLUMNS] + ["eval_is_gold_standard"]


def _out(spark, name):
    return scratch_path(spark, f"sinks/{name}-{uuid.uuid4().hex[:8]}")


@query(
    "k01_csv_sink",
    "SELECT cluster, CAST(count(*) AS BIGINT) AS size FROM f_meta GROUP BY 1",
    ("f_meta",),
)
def q_k01(spark, sf):
    path = _out(spark, "sizes")
    write_table(A.cluster_sizes(fx(spark, sf, "f_meta").select("jd_id", "cluster")), path, fmt="csv")
    return spark.read.option("header", True).schema("cluster int, size bigint").csv(path)


@query(
    "k03_vector_sink",
    "SELECT jd_id, CAST(len(features) AS BIGINT) AS dims, round(CAST(features[1] AS DOUBLE), 6) AS first FROM f_vectors",
    ("f_vectors",),
)
def q_k03(spark, sf):
    path = _out(spark, "vectors")
    write_table(fx(spark, sf, "f_vectors").select("jd_id", "features"), path)
    v = spark.read.parquet(path)
    return v.select("jd_id", F.size("features").cast("bigint").alias("dims"), rnd(F.col("features")[0].cast("double"), 6).alias("first"))


@query(
    "k04_eval_export",
    "SELECT jd_id, org_unit, level, " + ", ".join(f"'' AS {c}" for c in EVAL_COLUMNS)
    + " FROM f_corpus ORDER BY md5(jd_id || '42'), jd_id LIMIT 100",
    ("f_corpus",),
)
def q_k04(spark, sf):
    s = sampling.random_sample(fx(spark, sf, "f_corpus"), 100, 42).select("jd_id", "org_unit", "level")
    sheet = s.select("*", *[F.lit("").alias(c) for c in EVAL_COLUMNS])
    path = _out(spark, "eval_sheet")
    write_table(sheet, path, fmt="csv")
    back = spark.read.option("header", True).csv(path)
    # CSV has no empty-string/NULL distinction; blanks come back as NULL
    return back.select("jd_id", "org_unit", "level", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in EVAL_COLUMNS])


@query(
    "k04_eval_json",
    """WITH s AS (SELECT jd_id, completeness, clarity, specificity, compliance, actionability, is_gold_standard,
  list_filter([completeness, clarity, specificity, compliance, actionability], lambda x: x IS NOT NULL) AS given FROM f_evals)
SELECT s.jd_id, CAST(completeness AS DOUBLE) AS completeness, CAST(specificity AS DOUBLE) AS specificity, s.is_gold_standard,
  round(list_sum(given) / len(given), 2) AS average_score FROM s JOIN f_corpus c ON s.jd_id = c.jd_id""",
    ("f_evals", "f_corpus"),
)
def q_k04_json(spark, sf):
    """Completed evaluations written as {jd_data, evaluation} and imported again."""
    sample = fx(spark, sf, "f_corpus").join(fx(spark, sf, "f_evals"), "jd_id")
    path = _out(spark, "evaluations") + ".json"
    records = quality.evaluation_records(sample, ["jd_text", "org_unit", "level", "title", "posting_date"])
    write_table(records, path, fmt="json", ignoreNullFields="false")
    back = quality.import_json_evaluations(read_evaluations(spark, path, quality.EVALUATION_SCHEMA, lines=True), order_col="_file_order")
    return back.select("jd_id", F.col("completeness").cast("double"), F.col("specificity").cast("double"), "is_gold_standard", "average_score")
