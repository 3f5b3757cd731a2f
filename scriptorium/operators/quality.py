"""Human quality scores: rubric columns, import rules and analysis.

All analyses are global or grouped aggregates over the evaluation table; the
evaluation table is as large as the scored sample, the metadata side of the
J01 join is the whole corpus and is joined on the string id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.numeric import rnd

from scriptorium.functions.dates import days_between, month_label, parse_date, quarter_label

# --- fixed values ----------------------------------------------------------
DIMENSIONS = ["completeness", "clarity", "specificity", "compliance", "actionability"]
MIN_VALID_FOR_RECENCY = 5
MIN_PERIOD_COUNT = 2
MIN_MONTHS = 3
MIN_TREND_SIDE = 3
PROBLEM_THRESHOLD = 3.0
# ---------------------------------------------------------------------------


def average_score(dims=DIMENSIONS) -> Column:
    """Mean of the non-null scores, 2 dp; NULL when none is set."""
    arr = F.filter(F.array(*[F.col(d).cast("double") for d in dims]), lambda x: x.isNotNull())
    total = F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(arr) > 0, rnd(total / F.size(arr), 2))


def with_rubric(evals: DataFrame) -> DataFrame:
    """Rubric columns with ``average_score``; missing notes become ''."""
    out = evals
    for d in DIMENSIONS + ["overall"]:
        note = f"{d}_notes"
        if note not in out.columns:
            out = out.withColumn(note, F.lit(""))
    if "overall_score" not in out.columns:
        out = out.withColumn("overall_score", F.lit(None).cast("int"))
    return out.withColumn("average_score", average_score())


def gold_flag(c) -> Column:
    """TRUE only when the upper-cased text is 'TRUE'."""
    c = F.col(c) if isinstance(c, str) else c
    return F.upper(F.coalesce(c.cast("string"), F.lit(""))) == "TRUE"


def import_csv_evaluations(raw: DataFrame, id_field: str = "jd_id", order_col: str | None = None) -> DataFrame:
    """F03 + F04 + C12 on an evaluation sheet read as strings.

    Rows without id, or with neither completeness nor overall score, are
    ignored; when an id repeats the last row wins (``order_col`` gives file
    order, e.g. a ``monotonically_increasing_id`` taken at read time).
    """
    def score(name):
        return F.col(name).try_cast("double").try_cast("int") if name in raw.columns else F.lit(None).cast("int")

    def note(name):
        return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in raw.columns else F.lit("")

    cols = [F.col(id_field).cast("string").alias(id_field)]
    for d in DIMENSIONS:
        cols += [score(f"eval_{d}").alias(d), note(f"eval_{d}_notes").alias(f"{d}_notes")]
    cols += [
        score("eval_overall_score").alias("overall_score"),
        note("eval_overall_notes").alias("overall_notes"),
        gold_flag(F.col("eval_is_gold_standard") if "eval_is_gold_standard" in raw.columns else F.lit(None)).alias(
            "is_gold_standard"
        ),
    ]
    ordered = raw if order_col else raw.withColumn("_ord", F.monotonically_increasing_id())
    oc = order_col or "_ord"
    rows = ordered.select(*cols, F.col(oc).alias("_ord")).where(
        F.col(id_field).isNotNull() & (F.col("completeness").isNotNull() | F.col("overall_score").isNotNull())
    )
    w = Window.partitionBy(id_field).orderBy(F.desc("_ord"))
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_ord").transform(with_rubric)


SCORES = [*DIMENSIONS, "overall_score"]
NOTES = [*[f"{d}_notes" for d in DIMENSIONS], "overall_notes"]
# jd_data of any fields; scores that are no whole numbers read as null.
EVALUATION_SCHEMA = (
    "jd_data map<string,string>, evaluation struct<"
    + ",".join([*[f"{c}:int" for c in SCORES], *[f"{c}:string" for c in NOTES], "is_gold_standard:boolean"])
    + ">"
)


def evaluation_records(sample: DataFrame, fields: list[str], id_field: str = "jd_id") -> DataFrame:
    """Nested records {jd_data, evaluation}, one for each row of ``sample``.

    jd_data holds the ``fields`` that ``sample`` has, as text.  Scores, notes
    and the gold flag come from columns of ``sample``, else they are blank:
    null, empty and false.
    """
    have = [f for f in dict.fromkeys([id_field, *fields]) if f in sample.columns]
    data = F.map_from_arrays(F.array(*[F.lit(f) for f in have]), F.array(*[F.col(f).cast("string") for f in have]))
    scores = [(F.col(c).cast("int") if c in sample.columns else F.lit(None).cast("int")).alias(c) for c in SCORES]
    notes = [(F.coalesce(F.col(c), F.lit("")) if c in sample.columns else F.lit("")).alias(c) for c in NOTES]
    gold = F.coalesce(F.col("is_gold_standard"), F.lit(False)) if "is_gold_standard" in sample.columns else F.lit(False)
    return sample.select(data.alias("jd_data"), F.struct(*scores, *notes, gold.alias("is_gold_standard")).alias("evaluation"))


def import_json_evaluations(records: DataFrame, id_field: str = "jd_id", order_col: str | None = None) -> DataFrame:
    """F03 on {jd_data, evaluation}: rows with an id and a non-empty evaluation; the last row of an id wins.

    Missing notes become empty, a missing gold flag false.  Unlike the sheet,
    an evaluation without scores counts.
    """
    e = F.col("evaluation")
    some = F.coalesce(*[e[c].cast("string") for c in [*SCORES, *NOTES, "is_gold_standard"]]).isNotNull()
    given = F.try_element_at("jd_data", F.lit(id_field))
    order = F.col(order_col) if order_col else F.monotonically_increasing_id()
    rows = records.select(
        given.alias(id_field),
        *[e[c].alias(c) for c in SCORES],
        *[F.coalesce(e[c], F.lit("")).alias(c) for c in NOTES],
        F.coalesce(e["is_gold_standard"], F.lit(False)).alias("is_gold_standard"),
        order.alias("_ord"),
        some.alias("_some"),
    ).where(F.col("_some") & (F.coalesce(F.col(id_field), F.lit("")) != ""))
    last = rows.groupBy(id_field).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (id_field, "_ord", "_some")]), "_ord").alias("row"))
    return last.select(id_field, "row.*").transform(with_rubric)


def merge_metadata(
    evals: DataFrame,
    sample: DataFrame,
    id_field: str = "jd_id",
    fields=("org_unit", "level", "posting_date"),
) -> DataFrame:
    """Evaluations left-joined to the sample's metadata on the string id."""
    keep = [id_field] + [f for f in fields if f in sample.columns]
    meta = sample.select(*[F.col(c).cast("string").alias(c) if c == id_field else F.col(c) for c in keep])
    return evals.withColumn(id_field, F.col(id_field).cast("string")).join(meta, id_field, "left")


def quality_overall(merged: DataFrame, id_field: str = "jd_id") -> DataFrame:
    """A10: dimension means, evaluated count, gold count and sorted gold ids."""
    gold = F.coalesce(F.col("is_gold_standard"), F.lit(False))
    return merged.agg(
        F.count(F.lit(1)).cast("bigint").alias("total_evaluated"),
        *[F.avg(d).alias(f"mean_{d}") for d in DIMENSIONS],
        F.avg("average_score").alias("mean_average_score"),
        F.count_if(gold).cast("bigint").alias("gold_standard_count"),
        F.array_join(F.array_sort(F.collect_list(F.when(gold, F.col(id_field)))), ",").alias("gold_standard_ids"),
    )


def quality_by_group(merged: DataFrame, field: str) -> DataFrame:
    """Mean and count of ``average_score`` per value; NULL key dropped."""
    return (
        merged.where(F.col(field).isNotNull())
        .groupBy(field)
        .agg(F.avg("average_score").alias("mean"), F.count("average_score").cast("bigint").alias("count"))
    )


def _valid_dated(merged: DataFrame, date_field: str) -> DataFrame:
    """parsed date and score both present; fewer than 5 rows -> empty."""
    return merged.withColumn("_d", parse_date(F.col(date_field))).where(
        F.col("_d").isNotNull() & F.col("average_score").isNotNull()
    )


def _gate(v: DataFrame) -> DataFrame:
    # The gate is a scalar subquery: the count runs as its own small job and
    # no row is moved to a single task.
    n = v.select(F.count(F.lit(1))).scalar()
    return v.where(n >= MIN_VALID_FOR_RECENCY)


def quality_by_period(merged: DataFrame, period: str = "quarter", date_field: str = "posting_date") -> DataFrame:
    """Mean (2 dp) and count per quarter or month, count >= 2.

    Months are reported only when at least three months remain.
    """
    v = _gate(_valid_dated(merged, date_field))
    label = quarter_label(F.col("_d")) if period == "quarter" else month_label(F.col("_d"))
    g = (
        v.groupBy(label.alias("period"))
        .agg(rnd(F.avg("average_score"), 2).alias("mean"), F.count(F.lit(1)).cast("bigint").alias("count"))
        .where(F.col("count") >= MIN_PERIOD_COUNT)
    )
    if period == "month":
        g = g.where(g.select(F.count(F.lit(1))).scalar() >= MIN_MONTHS)
    return g


def quality_trend(merged: DataFrame, date_field: str = "posting_date") -> DataFrame:
    """Recent (>= median date) versus older; both sides need 3 rows."""
    v = _gate(_valid_dated(merged, date_field)).withColumn("_us", F.unix_micros(F.col("_d").cast("timestamp")))
    med = v.select(F.percentile("_us", 0.5)).scalar()
    recent = F.col("_us") >= med
    s = v.agg(
        F.avg(F.when(recent, F.col("average_score"))).alias("rm"),
        F.count_if(recent).cast("bigint").alias("recent_count"),
        F.avg(F.when(~recent, F.col("average_score"))).alias("om"),
        F.count_if(~recent).cast("bigint").alias("older_count"),
    ).where((F.col("recent_count") >= MIN_TREND_SIDE) & (F.col("older_count") >= MIN_TREND_SIDE))
    return s.select(
        rnd("rm", 2).alias("recent_mean"),
        "recent_count",
        rnd("om", 2).alias("older_mean"),
        "older_count",
        rnd(F.col("rm") - F.col("om"), 2).alias("difference"),
        F.when(F.col("rm") > F.col("om"), "improving").when(F.col("rm") < F.col("om"), "declining").otherwise("stable").alias(
            "trend"
        ),
    )


def quality_date_correlation(merged: DataFrame, date_field: str = "posting_date") -> DataFrame:
    """Pearson r of whole days since the earliest date against the score."""
    v = _gate(_valid_dated(merged, date_field))
    first = v.select(F.min("_d")).scalar()
    x = days_between(F.col("_d"), first).cast("double")
    y = F.col("average_score")
    # Pearson r with a guarded denominator: no variance gives NULL (``corr``
    # raises a division by zero under ANSI mode instead)
    r = v.agg(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias("r")).where(
        F.col("r").isNotNull() & ~F.isnan("r")
    )
    return r.select(
        rnd("r", 3).alias("coefficient"),
        F.when(F.col("r") > 0.1, "positive (newer JDs score higher)")
        .when(F.col("r") < -0.1, "negative (older JDs score higher)")
        .otherwise("no significant correlation")
        .alias("interpretation"),
    )


def quality_date_range(merged: DataFrame, date_field: str = "posting_date") -> DataFrame:
    """Earliest, latest and span in days of the valid rows."""
    v = _gate(_valid_dated(merged, date_field))
    return v.agg(F.min("_d").alias("lo"), F.max("_d").alias("hi")).where(F.col("lo").isNotNull()).select(
        F.date_format("lo", "yyyy-MM-dd").alias("earliest"),
        F.date_format("hi", "yyyy-MM-dd").alias("latest"),
        days_between(F.col("hi"), F.col("lo")).alias("span_days"),
    )


def score_distribution(merged: DataFrame) -> DataFrame:
    """Count per score value per dimension (NULL scores skipped)."""
    long = merged.select(*[F.col(d).cast("bigint").alias(d) for d in DIMENSIONS]).unpivot([], DIMENSIONS, "dimension", "score")
    return long.where(F.col("score").isNotNull()).groupBy("dimension", "score").agg(F.count(F.lit(1)).cast("bigint").alias("count"))


def problem_areas(merged: DataFrame) -> DataFrame:
    """Dimensions (and ``average_score``) whose mean is below 3."""
    names = DIMENSIONS + ["average_score"]
    wide = merged.agg(*[F.avg(d).alias(d) for d in names])
    return wide.unpivot([], names, "dimension", "mean").where(F.col("mean") < PROBLEM_THRESHOLD)
