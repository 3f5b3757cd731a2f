"""Schema discovery, field mapping and flattening over VARIANT records
(P01-P07, P10, A01-A03, F11-F14, T16).

Discovery walks the records level by level: every object is expanded into
(path, value) rows by casting it to ``map<string,variant>`` and exploding; the
elements of an array that are objects are expanded under ``path[*]``.  Each level is a narrow transformation of the previous one; one
``groupBy(path)`` with partial aggregation produces the statistics, so the
whole corpus is inspected (no 100-record sample) in a single shuffle of small
rows.  Key order inside a record is not kept by VARIANT: "discovery order" is
first record, then key name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.arrays import let

from scriptorium.functions.numeric import rnd

# --- fixed values (must equal the reference for equal results) -------------
ID_INDICATORS = ["id", "_id", "uuid", "guid", "key", "code", "number"]
METADATA_INDICATORS = [
    "org", "unit", "department", "dept", "division",
    "level", "grade", "band", "tier",
    "title", "role", "position",
    "function", "category", "type",
    "location", "city", "country", "region",
    "date", "created", "posted", "updated", "modified",
    "status", "state", "active",
    "manager", "team", "group",
]
STANDARD_FIELD_INDICATORS = {
    "org_unit": ["org", "unit", "organization"],
    "department": ["department", "dept", "division"],
    "level": ["level", "grade", "band", "tier"],
    "title": ["title", "job_title", "position_title", "role_title"],
    "function": ["function", "job_function", "category"],
    "location": ["location", "city", "office"],
    "posting_date": ["date", "posted", "created", "posting"],
    "status": ["status", "state"],
}
STANDARD_FIELDS = [
    "jd_id", "jd_text", "org_unit", "department", "level", "title", "function", "location",
    "posting_date", "status", "responsibilities", "required_qualifications", "preferred_qualifications",
    "team_description",
]
MIN_TEXT_AVG_LENGTH = 100
# ---------------------------------------------------------------------------


def json_type(v: Column) -> Column:
    """Seven type names of the reference from a VARIANT value."""
    s = F.schema_of_variant(v)
    head = F.split(s, "[<(]")[0]
    return (
        F.when(head == "OBJECT", "object")
        .when(head == "ARRAY", "array")
        .when(head == "STRING", "string")
        .when(head == "BOOLEAN", "boolean")
        .when(head.isin("TINYINT", "SMALLINT", "INT", "BIGINT"), "integer")
        .when((head == "DECIMAL") & s.endswith(",0)"), "integer")
        .when(head.isin("DECIMAL", "DOUBLE", "FLOAT"), "number")
        .when(head == "VOID", "null")
        .otherwise(F.lower(head))
    )


def _entries_of(obj: Column, prefix: Column) -> Column:
    """(path, parent, key, value) of every key of an object VARIANT, as an array."""
    m = F.map_entries(F.try_variant_get(obj, "$", "map<string,variant>"))
    return F.transform(
        F.coalesce(m, F.array().cast("array<struct<key:string,value:variant>>")),
        lambda e: F.struct(
            F.when(prefix.isNull(), e["key"]).otherwise(F.concat(prefix, F.lit("."), e["key"])).alias("path"),
            prefix.alias("parent"),
            e["key"].alias("key"),
            e["value"].alias("value"),
        ),
    )


def _children(path: Column, value: Column, array_inspect: int | None) -> Column:
    """Keys of an object value, and keys of the object elements of an array
    value (under ``path[*]``)."""
    arr = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))
    if array_inspect is not None:
        arr = F.slice(arr, 1, array_inspect)
    elems = F.filter(arr, lambda x: json_type(x) == "object")
    from_arr = F.flatten(F.transform(elems, lambda x: _entries_of(x, F.concat(path, F.lit("[*]")))))
    return F.concat(_entries_of(value, path), from_arr)


def record_depth(record: Column) -> Column:
    """Nested object levels of a VARIANT, from the braces of its JSON text outside strings."""
    bare = F.regexp_replace(F.to_json(record), r'"(?:[^"\\]|\\.)*+"', "")
    marks = F.split(F.regexp_replace(bare, "[^{}]", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(s: Column, mark: Column) -> Column:
        now = s["now"] + F.when(mark == "{", 1).when(mark == "}", -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))

    return F.aggregate(marks, start, step, lambda s: s["most"])


def path_entries(records: DataFrame, record_col: str = "record", max_depth: int | None = None, array_inspect: int | None = None, rid_col: str | None = None) -> DataFrame:
    """(rid, path, parent, key, value, type) for every key of every object.

    All levels of a record are built inside one projection: level k+1 is the
    children of level k (each level bound once with ``let``), the levels are
    concatenated and a single ``inline`` emits the rows.  No row is copied per
    level.  The records are numbered where they lie and then dealt to all cores,
    as reading levels costs far more than reading a file that few tasks share;
    records that already carry a number (``rid_col``) stay where they are.
    The number of levels is that of the deepest record, found by a pass over the
    records; ``max_depth`` and ``array_inspect`` (elements of an array) state a
    bound.
    """
    if rid_col is None:
        records, rid_col = records.select(F.monotonically_increasing_id().alias("rid"), record_col).repartition("rid"), "rid"
    depth = max_depth or records.agg(F.max(record_depth(F.col(record_col)))).first()[0] or 1

    def levels(prev, level):
        if level == depth - 1:
            return prev
        nxt = F.flatten(F.transform(prev, lambda e: _children(e["path"], e["value"], array_inspect)))
        return F.concat(prev, let(nxt, lambda lv: levels(lv, level + 1)))

    root = _entries_of(F.col(record_col), F.lit(None).cast("string"))
    allv = let(root, lambda lv: levels(lv, 0))
    rows = records.select(F.col(rid_col).alias("rid"), F.inline(allv))
    return rows.withColumn("type", json_type(F.col("value")))


def schema_summary(records: DataFrame, record_col: str = "record", max_depth: int | None = None, array_inspect: int | None = None, rid_col: str | None = None) -> DataFrame:
    """Per path count, null_count, null_rate (3 dp), sorted type set,
    string and array length statistics (kept apart), nested keys, first seen.

    Entries are first grouped by (path, parent, key), a table as small as the
    schema; from it each row serves its path (statistics) and its parent (keys).
    """
    e = path_entries(records, record_col, max_depth, array_inspect, rid_col)
    t = F.col("type")
    e = e.withColumn("slen", F.when(t == "string", F.length(F.try_variant_get("value", "$", "string"))))
    e = e.withColumn("alen", F.when(t == "array", F.size(F.try_variant_get("value", "$", "array<variant>"))))
    sums = [F.count(F.lit(1)).alias("n"), F.count_if(t == "null").alias("nulls"), F.collect_set(t).alias("types"), F.min("rid").alias("rid")]
    for c in ("slen", "alen"):
        sums += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.sum(c).alias(f"{c}_sum"), F.count(c).alias(f"{c}_n")]
    small = e.groupBy("path", "parent", "key").agg(*sums)
    # an object's keys; those of array elements hang under "path[*]", which is no path itself
    stats = [c for c in small.columns if c not in ("path", "parent", "key")]
    as_path = F.struct("path", *[F.col(c) for c in stats], F.lit(None).cast("string").alias("nested"))
    as_key = F.struct(F.col("parent").alias("path"), *[F.lit(None).cast(small.schema[c].dataType).alias(c) for c in stats], F.col("key").alias("nested"))
    both = small.select(F.inline(F.array(as_path, as_key)))
    out = both.groupBy("path").agg(
        F.sum("n").alias("count"),
        F.sum("nulls").alias("null_count"),
        rnd(F.sum("nulls") / F.sum("n"), 3).alias("null_rate"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("types")))), ",").alias("types"),
        F.min("slen_min").cast("bigint").alias("str_min_len"),
        F.max("slen_max").cast("bigint").alias("str_max_len"),
        rnd(F.try_divide(F.sum("slen_sum"), F.sum("slen_n")), 1).alias("str_avg_len"),
        F.min("alen_min").cast("bigint").alias("arr_min_len"),
        F.max("alen_max").cast("bigint").alias("arr_max_len"),
        rnd(F.try_divide(F.sum("alen_sum"), F.sum("alen_n")), 1).alias("arr_avg_len"),
        F.array_join(F.array_sort(F.collect_set("nested")), ",").alias("nested_keys"),
        F.min("rid").alias("first_seen"),
    )
    return out.where(F.col("count").isNotNull())


def field_paths(summary: DataFrame, type_filter: str | None = None) -> DataFrame:
    """paths whose type set contains ``type_filter`` (all paths when None)."""
    s = summary if type_filter is None else summary.where(F.array_contains(F.split("types", ","), type_filter))
    return s.select("path")


def text_field_candidates(summary: DataFrame, min_avg_length: int = MIN_TEXT_AVG_LENGTH) -> DataFrame:
    """string paths with average length >= min, longest first (rank)."""
    s = summary.where(F.array_contains(F.split("types", ","), "string") & (F.col("str_avg_len") >= min_avg_length))
    return s.select("path", F.col("str_avg_len").alias("avg_length"), F.col("str_max_len").alias("max_length"), "null_rate")


def _contains_any(c: Column, words) -> Column:
    cond = F.lit(False)
    for w in words:
        cond = cond | (F.instr(F.lower(c), w) > 0)
    return cond


def id_field_candidates(summary: DataFrame) -> DataFrame:
    """F12."""
    return summary.where(_contains_any(F.col("path"), ID_INDICATORS)).select("path", "first_seen")


def metadata_candidates(summary: DataFrame) -> DataFrame:
    """F13."""
    return summary.where(_contains_any(F.col("path"), METADATA_INDICATORS)).select("path", "first_seen")


def suggest_mapping(summary: DataFrame) -> DataFrame:
    """(standard_field, path): longest text path, first id path, first
    metadata path per standard field (discovery order)."""
    from pyspark.sql import Window

    text = text_field_candidates(summary).select(
        F.lit("jd_text").alias("standard_field"), "path", F.lit(0).alias("o1"), (-F.col("avg_length")).alias("o2"), F.lit(0).alias("o3")
    )
    ids = id_field_candidates(summary).select(
        F.lit("jd_id").alias("standard_field"), "path", F.lit(0).alias("o1"), F.col("first_seen").cast("double").alias("o2"), F.lit(0).alias("o3")
    )
    meta = metadata_candidates(summary)
    parts = [text, ids]
    for i, (field, inds) in enumerate(STANDARD_FIELD_INDICATORS.items()):
        parts.append(
            meta.where(_contains_any(F.col("path"), inds)).select(
                F.lit(field).alias("standard_field"), "path", F.lit(0).alias("o1"), F.col("first_seen").cast("double").alias("o2"), F.lit(i).alias("o3")
            )
        )
    allc = parts[0]
    for p in parts[1:]:
        allc = allc.unionByName(p)
    w = Window.partitionBy("standard_field").orderBy("o1", "o2", "path")
    return allc.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("standard_field", "path")


# ---------------------------------------------------------------- mapping

def json_path(dotted: str) -> str:
    """Dotted path -> JSON path; digit parts are object keys (as in the
    reference, a key is tried before an index) - see ``path_get``."""
    parts = dotted.split(".")
    return "$" + "".join(f"['{p}']" for p in parts)


def path_get(record: Column, dotted: str, as_type: str = "string") -> Column:
    """Value at a dotted path; a digit part is a key of an object or an
    index of an array, tried in that order; absent -> NULL."""

    def walk(value: Column, parts: list[str]) -> Column:
        cut = next((i for i, p in enumerate(parts) if p.isdigit()), None)
        if cut is None:
            return F.try_variant_get(value, "$" + "".join(f"['{p}']" for p in parts), as_type)
        head, digits, tail = "$" + "".join(f"['{p}']" for p in parts[:cut]), parts[cut], parts[cut + 1 :]
        kind = "variant" if tail else as_type
        found = F.coalesce(F.try_variant_get(value, f"{head}['{digits}']", kind), F.try_variant_get(value, f"{head}[{int(digits)}]", kind))
        return let(found, lambda v: walk(v, tail)) if tail else found

    return walk(record, dotted.split("."))


def map_fields(records: DataFrame, mapping: dict[str, str | None], record_col: str = "record", custom_fields: dict[str, str] | None = None) -> DataFrame:
    """Standard and custom fields from source paths; unmapped (None)
    fields are omitted; an absent path gives NULL; text values as strings."""
    cols = [path_get(F.col(record_col), p).alias(name) for name, p in mapping.items() if p]
    cols += [path_get(F.col(record_col), p).alias(name) for name, p in (custom_fields or {}).items() if p]
    keep = [c for c in records.columns if c.startswith("_") and c != record_col]
    return records.select(*cols, *keep)


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested structs -> one column per leaf named ``a.b``; arrays kept whole."""
    from pyspark.sql.types import StructType

    def walk(schema: StructType, prefix: list[str]):
        out = []
        for f in schema.fields:
            path = prefix + [f.name]
            if isinstance(f.dataType, StructType):
                out += walk(f.dataType, path)
            else:
                out.append(F.col(".".join(f"`{p}`" for p in path)).alias(sep.join(path)))
        return out

    return df.select(*walk(df.schema, []))


def available_columns(df: DataFrame, wanted) -> list[str]:
    """Configured columns that exist, in the configured order."""
    return [c for c in wanted if c in df.columns]


def validate_config(columns, text_field: str, id_field: str, optional: dict[str, str]) -> list[tuple[str, str, str]]:
    """(severity, field, message): missing text/id field is an error,
    a missing optional field a warning naming its fallback."""
    out = []
    for f in (text_field, id_field):
        if f not in columns:
            out.append(("error", f, f"required field '{f}' not found"))
    for f, fallback in optional.items():
        if f not in columns:
            out.append(("warning", f, f"field '{f}' not found; {fallback}"))
    return out


def detect_column(columns, *needles: str) -> str | None:
    """First column whose lower-case name contains all needles."""
    for c in columns:
        if all(n in c.lower() for n in needles):
            return c
    return None


def public_columns(df: DataFrame) -> DataFrame:
    """P10: drop internal ``_`` columns (``_raw`` and friends)."""
    return df.select(*[c for c in df.columns if not c.startswith("_")])
