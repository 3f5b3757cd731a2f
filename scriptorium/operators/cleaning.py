"""Corpus cleaning and corpus statistics.

``clean_corpus`` is one projection plus two filters; the statistics are single
global aggregates (partial aggregation on every partition, one tiny final
merge), so the cost is one scan whatever the corpus size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.numeric import rnd

from scriptorium.functions.text import (
    MIN_TEXT_LENGTH,
    fix_mojibake,
    squeeze_whitespace,
    strip_html,
)


def with_clean_text(df: DataFrame, text_field: str = "jd_text") -> DataFrame:
    """Add ``_clean`` (struct of the cleaned text, lengths, change flags).

    The HTML step is materialised in its own projection so that the entity
    UDF is evaluated once per row.
    """
    t0 = F.col(text_field)
    step1 = df.withColumn(
        "_t1", F.when(t0.isNotNull() & (F.length(t0) > 0), strip_html(t0)).otherwise(t0)
    )
    t1 = F.col("_t1")
    step2 = step1.withColumn("_t2", F.when(F.length(t1) > 0, squeeze_whitespace(t1)).otherwise(t1))
    t2 = F.col("_t2")
    step3 = step2.withColumn("_t3", F.when(F.length(t2) > 0, fix_mojibake(t2)).otherwise(t2))
    t3 = F.col("_t3")
    return step3.withColumn(
        "_clean",
        F.struct(
            t3.alias("clean"),
            F.length(t0).cast("bigint").alias("len_before"),
            F.when(t0.isNotNull(), F.coalesce(F.length(t3), F.lit(0))).cast("bigint").alias("len_after"),
            F.coalesce((F.length(t0) > 0) & (t1 != t0), F.lit(False)).alias("html_changed"),
            F.coalesce((F.length(t1) > 0) & (t2 != t1), F.lit(False)).alias("ws_changed"),
            F.coalesce((F.length(t2) > 0) & (t3 != t2), F.lit(False)).alias("enc_changed"),
        ),
    ).drop("_t1", "_t2", "_t3")


def clean_corpus(
    df: DataFrame,
    text_field: str = "jd_text",
    min_text_length: int = MIN_TEXT_LENGTH,
    drop_missing_text: bool = True,
    custom_cleaners: dict[str, Callable[[Column], Column]] | None = None,
) -> DataFrame:
    """Cleaned corpus: text replaced by its cleaned form, F01 and F02 applied.

    ``custom_cleaners`` (X01) maps a column to a ``Column -> Column`` function;
    a plain Python callable may be wrapped with ``F.udf(fn, useArrow=True)``.
    """
    def keep(t):
        cond = F.lit(True)
        if drop_missing_text:
            cond = cond & t.isNotNull() & (F.length(t) > 0)
        if min_text_length > 0:
            # pandas compares NaN lengths as False, so missing text survives
            # this filter when it was not dropped before.
            cond = cond & (t.isNull() | (F.length(t) >= min_text_length))
        return cond

    # The filter is applied inside a one-element generator: a plain Filter on
    # the cleaned text would be pushed below the projection and run every
    # cleaning regex twice (once in the filter, once in the projection).
    others = [c for c in df.columns if c != text_field]
    cleaned = with_clean_text(df, text_field)
    out = cleaned.select(*others, F.explode(F.filter(F.array(F.col("_clean.clean")), keep)).alias(text_field))
    out = out.select(*df.columns)
    for name, fn in (custom_cleaners or {}).items():
        if name in out.columns:
            out = out.withColumn(name, fn(F.col(name)))
    return out


def cleaning_stats(
    df: DataFrame,
    text_field: str = "jd_text",
    min_text_length: int = MIN_TEXT_LENGTH,
    drop_missing_text: bool = True,
) -> DataFrame:
    """One row of cleaning counters, computed in one aggregate."""
    c = with_clean_text(df, text_field)
    clean = F.col("_clean.clean")
    has = clean.isNotNull() & (F.length(clean) > 0)
    short_base = has if drop_missing_text else F.lit(True)
    too_short = short_base & (F.length(clean) < min_text_length) if min_text_length > 0 else F.lit(False)
    n = F.count(F.lit(1))
    agg = c.agg(
        n.cast("bigint").alias("total_records"),
        F.count_if(has).cast("bigint").alias("records_with_text"),
        F.count_if(~has | clean.isNull()).cast("bigint").alias("records_missing_text"),
        rnd(F.count_if(has) / F.greatest(n, F.lit(1)), 3).alias("text_coverage_rate"),
        F.count_if(F.col("_clean.html_changed")).cast("bigint").alias("html_tags_removed"),
        F.count_if(F.col("_clean.ws_changed")).cast("bigint").alias("extra_whitespace_cleaned"),
        F.count_if(F.col("_clean.enc_changed")).cast("bigint").alias("encoding_issues_fixed"),
        F.coalesce(F.min("_clean.len_before"), F.lit(0)).cast("bigint").alias("len_before_min"),
        F.coalesce(F.max("_clean.len_before"), F.lit(0)).cast("bigint").alias("len_before_max"),
        F.coalesce(rnd(F.avg("_clean.len_before"), 1), F.lit(0.0)).alias("len_before_avg"),
        F.coalesce(F.min("_clean.len_after"), F.lit(0)).cast("bigint").alias("len_after_min"),
        F.coalesce(F.max("_clean.len_after"), F.lit(0)).cast("bigint").alias("len_after_max"),
        F.coalesce(rnd(F.avg("_clean.len_after"), 1), F.lit(0.0)).alias("len_after_avg"),
        (F.count_if(~has) if drop_missing_text else F.lit(0)).cast("bigint").alias("dropped_missing_text"),
        F.count_if(too_short).cast("bigint").alias("dropped_text_too_short"),
    )
    return agg


def fill_rates(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """(field, rate) - non-null share per column, internal ``_`` columns skipped."""
    cols = [c for c in (columns or df.columns) if not c.startswith("_")]
    n = F.count(F.lit(1))
    wide = df.agg(*[rnd(F.try_divide(F.count(F.col(f"`{c}`")), n), 3).alias(c) for c in cols])
    return wide.unpivot([], cols, "field", "rate").select("field", F.coalesce("rate", F.lit(0.0)).alias("rate"))


def value_counts(df: DataFrame, fields: Iterable[str], max_values: int = 20) -> DataFrame:
    """Top ``max_values`` values per field, NULLs skipped, ties by value.

    One ``unpivot`` and one aggregate instead of one scan per field; the rank
    filter becomes a map-side WindowGroupLimit, so a field with many distinct
    values sends at most ``max_values`` rows per partition to the final rank.
    """
    fields = [f for f in fields if f in df.columns]
    long = df.select(*[F.col(f).cast("string").alias(f) for f in fields]).unpivot([], fields, "field", "value")
    counts = long.where(F.col("value").isNotNull()).groupBy("field", "value").agg(F.count(F.lit(1)).alias("count"))
    w = _rank_window(["field"], [F.desc("count"), F.asc("value")])
    return (
        counts.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= max_values)
        .select("field", "value", F.col("count").cast("bigint").alias("count"), F.col("rank").cast("bigint").alias("rank"))
    )


def _rank_window(parts, order):
    from pyspark.sql import Window

    return Window.partitionBy(*parts).orderBy(*order)


def length_describe(df: DataFrame, column: str) -> DataFrame:
    """Pandas ``describe()`` of a numeric column (linear percentiles)."""
    x = F.col(column).cast("double")
    return df.agg(
        F.count(x).cast("bigint").alias("count"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"),
        F.percentile(x, 0.25).alias("p25"),
        F.percentile(x, 0.5).alias("p50"),
        F.percentile(x, 0.75).alias("p75"),
        F.max(x).alias("max"),
    )


def text_length_describe(df: DataFrame, text_field: str = "jd_text") -> DataFrame:
    return length_describe(df.select(F.length(text_field).alias("text_length")), "text_length")


def corpus_stats(
    df: DataFrame,
    text_field: str = "jd_text",
    title_field: str = "title",
    org_field: str = "org_unit",
    level_field: str = "level",
    date_field: str = "posting_date",
) -> DataFrame:
    """Totals, distinct counts, text length and date range in one row."""
    from scriptorium.functions.dates import parse_date

    d = parse_date(F.col(date_field))
    ln = F.length(text_field)
    return df.agg(
        F.count(F.lit(1)).cast("bigint").alias("total_jds"),
        F.count_distinct(title_field).cast("bigint").alias("unique_titles"),
        F.count_distinct(org_field).cast("bigint").alias("unique_org_units"),
        F.count_distinct(level_field).cast("bigint").alias("unique_levels"),
        rnd(F.avg(ln), 1).alias("avg_text_length"),
        F.min(ln).cast("bigint").alias("min_text_length"),
        F.max(ln).cast("bigint").alias("max_text_length"),
        F.date_format(F.min(d), "yyyy-MM-dd").alias("earliest_date"),
        F.date_format(F.max(d), "yyyy-MM-dd").alias("latest_date"),
    )
