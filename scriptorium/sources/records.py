"""Raw record sources (S01-S15, K01-K06 readers/writers).

Raw records are JSON texts parsed into VARIANT (``try_parse_json``): no schema
is needed up front, malformed texts become NULL and are split off, and every
nested value stays addressable by path.  Whole JSON files are read with the
``binaryFile`` source (one row per file; a single large file is not
splittable, so it should be landed once as Parquet); JSON Lines with the
ordinary splittable ``json`` source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.session import written

SYSTEM_FIELDS = ["_rid", "_self", "_etag", "_attachments", "_ts"]


def read_json_files(spark: SparkSession, path: str, pattern: str = "*.json", encoding: str = "utf-8") -> DataFrame:
    """S01 + S04: one row per file: (_source_file, value string), sorted by file path; no matching file is an error."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    if not raw.select("path").head(1):
        raise FileNotFoundError(f"no file in {path} matches {pattern}")
    return raw.orderBy("path").select(F.col("path").alias("_source_file"), F.decode("content", encoding).alias("value"))


def file_stats(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """File count, total MB (2 dp), first 10 names, truncated flag (content column pruned)."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length")
    first = raw.select(F.element_at(F.split("path", "/"), -1).alias("name")).orderBy("name").limit(10)
    return raw.agg(
        F.count(F.lit(1)).cast("bigint").alias("num_files"),
        F.round(F.sum("length") / 1048576.0, 2).alias("total_size_mb"),
        first.select(F.array_sort(F.collect_list("name"))).scalar().alias("files"),
        (F.count(F.lit(1)) > 10).alias("files_truncated"),
    )


def parse_records(df: DataFrame, value_col: str = "value") -> DataFrame:
    """Parse JSON text into VARIANT ``v``; NULL where the text is malformed."""
    return df.withColumn("v", F.try_parse_json(F.col(value_col)))


def malformed(df: DataFrame) -> DataFrame:
    """Rows whose text does not parse (the reject table)."""
    return parse_records(df).where(F.col("v").isNull()).drop("v")


def _kind(v: Column) -> Column:
    return F.split(F.schema_of_variant(v), "<")[0]


def explode_records(df: DataFrame, content_key: str = "content", value_col: str = "value") -> DataFrame:
    """One row per record with VARIANT ``record``.

    An object holding an array under ``content_key`` gives one row per
    element; another object gives itself; an array gives one row per element;
    non-object elements and malformed texts are dropped.  Other columns (such
    as ``_source_file``) are carried along.
    """
    p = parse_records(df, value_col).where(F.col("v").isNotNull())
    keep = [c for c in p.columns if c not in ("v", value_col)]
    inner = F.try_variant_get("v", f"$.{content_key}", "array<variant>")
    arr = F.try_variant_get("v", "$", "array<variant>")
    elems = (
        F.when(_kind(F.col("v")) == "OBJECT", F.when(inner.isNotNull(), inner).otherwise(F.array(F.col("v"))))
        .when(_kind(F.col("v")) == "ARRAY", arr)
    )
    out = p.select(*keep, F.explode(elems).alias("record"))
    return out.where(_kind(F.col("record")) == "OBJECT")


def dealt(df: DataFrame, rid_col: str = "rid") -> DataFrame:
    """``df`` numbered in the order it is read and dealt to all cores, for texts in files that few tasks share."""
    return df.withColumn(rid_col, F.monotonically_increasing_id()).repartition(rid_col)


def drop_system_fields(df: DataFrame) -> DataFrame:
    """S07."""
    return df.drop(*SYSTEM_FIELDS)


def record_chunks(df: DataFrame, order_by: list[str], size: int = 1000) -> DataFrame:
    """Rows with their ``chunk`` (from 0) of ``size`` records in the order of ``order_by``; the last chunk is the rest.

    Rows are numbered by range partition: the partitions' counts, one row a
    partition, give each its first number, so no task holds more than its part.
    Rows equal in ``order_by`` fall in any order among themselves.
    """
    ranged = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    rows = written(ranged.withColumn("_at", F.monotonically_increasing_id()), "chunks").withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    number = F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(parts, "_part").withColumn("chunk", F.floor(number / size).cast("bigint")).drop("_at", "_part", "_first")


def read_source(spark: SparkSession, fmt: str, path: str | None = None, schema: str | None = None, **options) -> DataFrame:
    """Any Spark data source by format name (parquet,
    csv, json, a DSv2 connector ...). Filters and projections on the result
    are pushed to the source by Catalyst."""
    r = spark.read.format(fmt).options(**options)
    if schema is not None:
        r = r.schema(schema)
    return r.load(path) if path else r.load()


def evaluation_format(path: str) -> str:
    """Importer by file suffix; other suffixes are rejected."""
    if path.endswith(".json"):
        return "json"
    if path.endswith(".csv"):
        return "csv"
    raise ValueError(f"Unsupported file format: {path}")


def read_evaluations(spark: SparkSession, path: str, schema: str | None = None, lines: bool = False) -> DataFrame:
    """Evaluations with file order for 'last row wins': a sheet as strings, or JSON records.

    JSON files hold one array each, or one record a line (``lines``); ``schema``
    gives the records' types (``quality.EVALUATION_SCHEMA``).
    """
    if evaluation_format(path) == "csv":
        df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    else:
        reader = spark.read.option("multiLine", not lines)
        df = (reader.schema(schema) if schema else reader).json(path)
    return df.withColumn("_file_order", F.monotonically_increasing_id())


def source_sample(df: DataFrame, n: int = 5, order_by: str | None = None) -> DataFrame:
    """First n records (deterministic when ordered)."""
    return (df.orderBy(order_by) if order_by else df).limit(n)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by=None, **options) -> None:
    """CSV (header), JSON Lines or Parquet (arrays kept typed).

    Append mode with a run column as partition gives the checkpointed
    append of K06 without rewriting earlier output.
    """
    w = df.write.mode(mode).format(fmt).options(**options)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.save(path)
