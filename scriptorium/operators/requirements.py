"""Requirement records: parsing model output, rule extraction, text forms and
statistics (R01-R05, T08-T10, C05, C06, P08, F07, A42-A46).

The reference sends every text to a hosted chat model.  Here the record is
built by Spark jobs: a response column (from any model, produced elsewhere or
by a ``mapInPandas`` hook) is parsed with native JSON functions, and a
rule-based extractor joins word n-grams of the text to a dictionary of
(term, category) with an equi-join - the dictionary is joined, not
broadcast by hint, so AQE broadcasts it only when its measured size allows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.arrays import let

from scriptorium.functions.numeric import rnd

from scriptorium.functions.text import strip_code_fence

from scriptorium.session import written

# --- fixed values ----------------------------------------------------------
CATEGORIES = ["licenses", "certifications", "technical", "domain", "soft", "tools", "languages"]
SKILL_CATEGORIES = ["technical", "domain", "soft"]
_C = "struct<required:array<string>,preferred:array<string>>"
EXTRACTION_SCHEMA = (
    f"struct<licenses:{_C},certifications:{_C},skills:struct<technical:{_C},domain:{_C},soft:{_C}>,"
    f"education:struct<level:{_C},fields:array<string>>,"
    f"experience:struct<years_min:int,years_preferred:int,specific:{_C}>,tools:{_C},languages:{_C}>"
)
EDUCATION_LEVELS = [
    ("phd", "(?i)\\b(ph\\.?d|doctorate|doctoral)\\b"),
    ("masters", "(?i)\\b(master'?s?|msc|mba|m\\.s\\.)\\b"),
    ("bachelors", "(?i)\\b(bachelor'?s?|bsc|b\\.s\\.|undergraduate degree)\\b"),
    ("associate", "(?i)\\bassociate'?s? degree\\b"),
    ("high_school", "(?i)\\b(high school|secondary school|ged)\\b"),
]
YEARS_RULE = "(\\d+)\\s*\\+?\\s*(?:years|yrs)"
NO_REQUIREMENTS = "No requirements extracted"
# ---------------------------------------------------------------------------


def parse_response(df: DataFrame, response_col: str = "response", id_field: str = "jd_id") -> DataFrame:
    """T08 + C05 + P08: fenced model text -> typed record, success flag, error text.

    Malformed text gives ``extraction_success = false`` and an error message;
    every missing category becomes {required: [], preferred: []}.
    """
    body = strip_code_fence(F.col(response_col))
    v = F.try_parse_json(body)
    rec = F.try_variant_get(v, "$", EXTRACTION_SCHEMA)
    out = df.select(F.col(id_field).cast("string").alias(id_field), body.alias("_body"), v.alias("_v"), rec.alias("_rec"))
    return out.select(
        id_field,
        with_defaults(F.col("_rec")).alias("extraction"),
        F.col("_v").isNotNull().alias("extraction_success"),
        F.when(F.col("_v").isNull(), F.concat(F.lit("Failed to parse response as JSON: "), F.substring("_body", 1, 500))).alias(
            "extraction_error"
        ),
    )


def _cat(c: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.struct(F.coalesce(c["required"], empty).alias("required"), F.coalesce(c["preferred"], empty).alias("preferred"))


def with_defaults(rec: Column) -> Column:
    """Every category present with empty lists by default."""
    return F.struct(
        _cat(rec["licenses"]).alias("licenses"),
        _cat(rec["certifications"]).alias("certifications"),
        F.struct(*[_cat(rec["skills"][s]).alias(s) for s in SKILL_CATEGORIES]).alias("skills"),
        F.struct(_cat(rec["education"]["level"]).alias("level"), F.coalesce(rec["education"]["fields"], F.array().cast("array<string>")).alias("fields")).alias("education"),
        F.struct(
            rec["experience"]["years_min"].alias("years_min"),
            rec["experience"]["years_preferred"].alias("years_preferred"),
            _cat(rec["experience"]["specific"]).alias("specific"),
        ).alias("experience"),
        _cat(rec["tools"]).alias("tools"),
        _cat(rec["languages"]).alias("languages"),
    )


def records_from_items(items: DataFrame, years: DataFrame | None = None, id_field: str = "jd_id") -> DataFrame:
    """Long items (jd_id, pos, category, kind, item) -> one record per document.

    Lists keep item order (pos).  Grouping is per document, so a group is as
    large as one document's item list.
    """
    g = items.groupBy(id_field).agg(F.array_sort(F.collect_list(F.struct("pos", "category", "kind", "item"))).alias("_it"))

    def lst(cat, kind):
        return F.transform(F.filter("_it", lambda x: (x["category"] == cat) & (x["kind"] == kind)), lambda x: x["item"])

    def cat(c):
        return F.struct(lst(c, "required").alias("required"), lst(c, "preferred").alias("preferred"))

    rec = F.struct(
        cat("licenses").alias("licenses"),
        cat("certifications").alias("certifications"),
        F.struct(*[cat(s).alias(s) for s in SKILL_CATEGORIES]).alias("skills"),
        F.struct(cat("education").alias("level"), F.array().cast("array<string>").alias("fields")).alias("education"),
        F.struct(F.lit(None).cast("int").alias("years_min"), F.lit(None).cast("int").alias("years_preferred"), cat("experience").alias("specific")).alias("experience"),
        cat("tools").alias("tools"),
        cat("languages").alias("languages"),
    )
    out = g.select(id_field, rec.alias("extraction"), F.lit(True).alias("extraction_success"), F.lit(None).cast("string").alias("extraction_error"))
    if years is not None:
        out = out.join(years, id_field, "left").withColumn(
            "extraction",
            F.col("extraction").withField("experience.years_min", F.col("years_min")).withField("experience.years_preferred", F.col("years_preferred")),
        ).drop("years_min", "years_preferred")
    return out


def _both(c: Column) -> Column:
    return F.concat(c["required"], c["preferred"])


def requirements_text(
    ext: Column,
    include=("licenses", "certifications", "skills", "tools", "education", "experience"),
    fallback: bool = True,
) -> Column:
    """``Licenses: a, b; Certifications: ...; Skills: ...; Tools: ...;
    Education: ...; Experience: N+ years, ...`` - required before preferred,
    empty parts and 0/NULL years left out; NULL parts are skipped by concat_ws."""
    def part(label, arr):
        return F.when(F.size(arr) > 0, F.concat(F.lit(label + ": "), F.array_join(arr, ", ")))

    parts = []
    if "licenses" in include:
        parts.append(part("Licenses", _both(ext["licenses"])))
    if "certifications" in include:
        parts.append(part("Certifications", _both(ext["certifications"])))
    if "skills" in include:
        parts.append(part("Skills", F.concat(*[_both(ext["skills"][s]) for s in SKILL_CATEGORIES])))
    if "tools" in include:
        parts.append(part("Tools", _both(ext["tools"])))
    if "education" in include:
        parts.append(part("Education", F.concat(_both(ext["education"]["level"]), ext["education"]["fields"])))
    if "experience" in include:
        y = ext["experience"]["years_min"]
        yrs = F.when(F.coalesce(y, F.lit(0)) != 0, F.array(F.concat(y.cast("string"), F.lit("+ years")))).otherwise(F.array().cast("array<string>"))
        parts.append(part("Experience", F.concat(yrs, _both(ext["experience"]["specific"]))))
    txt = F.concat_ws("; ", *parts)
    return F.when(txt == "", F.lit(NO_REQUIREMENTS)).otherwise(txt) if fallback else txt


def contextual_text(ext_text: Column, context: dict[str, Column]) -> Column:
    """``[division: X] [function: Y] `` + requirements text (empty values skipped)."""
    ctx = [F.when(F.coalesce(c.cast("string"), F.lit("")) != "", F.concat(F.lit(f"[{k}: "), c.cast("string"), F.lit("]"))) for k, c in context.items()]
    pre = F.concat_ws(" ", *ctx)
    return F.when(pre == "", ext_text).otherwise(F.concat(pre, F.lit(" "), ext_text))


def items_of(records: DataFrame, id_field: str = "jd_id") -> DataFrame:
    """Record -> long items (jd_id, category, kind, item, pos)."""
    e = F.col("extraction")
    cats = {"licenses": e["licenses"], "certifications": e["certifications"], "tools": e["tools"], "languages": e["languages"]}
    cats.update({s: e["skills"][s] for s in SKILL_CATEGORIES})
    def tagged(arr, cat, kind):
        return F.transform(arr, lambda x, i: F.struct(F.lit(cat).alias("category"), F.lit(kind).alias("kind"), x.alias("item"), i.alias("pos")))

    arrs = [tagged(c[k], cat, k) for cat, c in cats.items() for k in ("required", "preferred")]
    return records.select(id_field, F.inline(F.concat(*arrs)))


def items_per_doc(records: DataFrame, id_field: str = "jd_id") -> DataFrame:
    """Items per category per document; total_skills; total_items adds
    total_skills again on top of all categories (the reference's sum), and
    total_items_distinct_categories counts each item once."""
    e = F.col("extraction")
    n = {c: F.size(_both(e[c])) for c in ["licenses", "certifications", "tools", "languages"]}
    n.update({s: F.size(_both(e["skills"][s])) for s in SKILL_CATEGORIES})
    total_skills = n["technical"] + n["domain"] + n["soft"]
    all_cats = sum(n.values(), F.lit(0))
    return records.select(
        id_field,
        *[v.cast("bigint").alias(f"n_{k}") for k, v in n.items()],
        total_skills.cast("bigint").alias("total_skills"),
        (all_cats + total_skills).cast("bigint").alias("total_items"),
        all_cats.cast("bigint").alias("total_items_distinct_categories"),
    )


def top_items(items: DataFrame, n: int = 15) -> DataFrame:
    """Top n items per category (ties by item)."""
    c = items.groupBy("category", "item").agg(F.count(F.lit(1)).cast("bigint").alias("count"))
    w = Window.partitionBy("category").orderBy(F.desc("count"), F.asc("item"))
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def required_vs_preferred(items: DataFrame) -> DataFrame:
    """Totals per category and kind (pivot with the two known kinds)."""
    return items.groupBy("category").pivot("kind", ["required", "preferred"]).agg(F.count(F.lit(1)).cast("bigint")).fillna(0)


def empty_rate(records: DataFrame) -> DataFrame:
    """% of documents with no item, per category (skills = any of the three)."""
    e = F.col("extraction")
    sizes = {c: F.size(_both(e[c])) for c in ["licenses", "certifications", "tools", "languages"]}
    sizes.update({s: F.size(_both(e["skills"][s])) for s in SKILL_CATEGORIES})
    sizes["skills"] = sizes["technical"] + sizes["domain"] + sizes["soft"]
    wide = records.agg(*[rnd(100 * F.avg((v == 0).cast("int")), 1).alias(k) for k, v in sizes.items()])
    return wide.unpivot([], list(sizes), "category", "empty_pct")


def extraction_summary(records: DataFrame, items: DataFrame) -> DataFrame:
    """A46 + F07: total, successful, success rate, items per successful doc, distinct items."""
    ok = records.where("extraction_success")
    n_items = items.join(ok.select("jd_id"), "jd_id", "left_semi")
    stats = n_items.agg(F.count(F.lit(1)).alias("_items"), F.count_distinct("item").cast("bigint").alias("distinct_items"))
    return _summary_join(records, stats)


def _summary_join(records: DataFrame, stats: DataFrame) -> DataFrame:
    tot = records.agg(F.count(F.lit(1)).cast("bigint").alias("total"), F.count_if("extraction_success").cast("bigint").alias("successful"))
    items = stats.select(F.col("_items"), "distinct_items")
    s = tot.select(
        "total",
        "successful",
        rnd(F.try_divide(100.0 * F.col("successful"), F.col("total")), 1).alias("success_rate"),
        rnd(F.try_divide(items.select(F.first("_items")).scalar(), F.col("successful")), 2).alias("avg_items_per_doc"),
        items.select(F.first("distinct_items")).scalar().alias("distinct_items"),
    )
    return s


def extract_years(text: Column) -> Column:
    """Smallest number of years mentioned as ``N years`` / ``N+ yrs``."""
    found = F.regexp_extract_all(text, F.lit(YEARS_RULE), 1)
    return F.array_min(F.transform(found, lambda x: x.cast("int")))


def extract_education(text: Column) -> Column:
    """Education levels named in the text, in the fixed order."""
    return F.filter(F.array(*[F.when(text.rlike(rx), F.lit(name)) for name, rx in EDUCATION_LEVELS]), lambda x: x.isNotNull())


def ngrams(text: Column, sizes: list[int]) -> Column:
    """Lower-case word n-grams of a text for every n in ``sizes``, as an array of strings.

    The word array is bound once (``let``): referenced inside the per-position
    lambdas it would otherwise be re-split for every position.
    """
    def grams(words: Column) -> Column:
        n_words = F.size(words)

        def grams_of(n):
            # positions 1..size-n+1; an empty range when the text has fewer words
            starts = F.filter(F.sequence(F.lit(1), F.greatest(n_words - (n - 1), F.lit(1))), lambda i: i + (n - 1) <= n_words)
            return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))

        return F.filter(F.concat(*[grams_of(n) for n in sizes]), lambda g: g != "")

    words = F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}#+]+"), lambda w: w != "")
    return let(words, grams)


def extract_requirements(
    texts: DataFrame,
    dictionary: DataFrame,
    text_col: str = "text",
    kind_col: str | None = None,
    id_field: str = "jd_id",
    broadcast_chars: int = 16 << 20,
) -> DataFrame:
    """Items found in the text by dictionary lookup.

    ``dictionary`` is (term, canonical, category); terms are matched on
    lower-case word n-grams of the lengths that its terms have.  It is written
    once and measured: up to ``broadcast_chars`` characters it is broadcast and
    the n-grams stay where they are; a larger one is joined by shuffle.
    ``kind_col`` (e.g. derived from the section type: preferred_qualifications
    -> preferred) defaults to 'required'.
    Output: long items (jd_id, category, kind, item) with one row per
    distinct (document, category, kind, item).  What repeats is taken out among
    the n-grams that are terms, before a term brings its items; the items
    themselves are compared only where one has several terms.
    """
    kind = F.col(kind_col) if kind_col else F.lit("required")
    d = written(dictionary.select(F.lower(F.col("term")).alias("gram"), F.col("canonical").alias("item"), "category").where("gram IS NOT NULL").distinct(), "terms")
    chars = F.length("gram") + F.coalesce(F.length("item"), F.lit(0)) + F.coalesce(F.length("category"), F.lit(0))
    lengths = d.groupBy(F.size(F.split("gram", " ")).alias("n")).agg(F.sum(chars).alias("chars")).collect()
    sizes = sorted(r["n"] for r in lengths) or [1]
    several = bool(d.groupBy("item", "category").count().where("count > 1").head(1))
    terms = d.select("gram").distinct()
    if sum(r["chars"] for r in lengths) <= broadcast_chars:
        d, terms = F.broadcast(d), F.broadcast(terms)
    g = texts.select(F.col(id_field).cast("string").alias(id_field), kind.alias("kind"), F.explode(F.array_distinct(ngrams(F.col(text_col), sizes))).alias("gram"))
    found = g.join(terms, "gram", "left_semi").distinct().join(d, "gram").select(id_field, "category", "kind", "item")
    return found.distinct() if several else found


def extract_batch(todo: DataFrame, extractor: Callable[[DataFrame], DataFrame], done: DataFrame | None = None, id_field: str = "jd_id", retry_failed: bool = False) -> DataFrame:
    """R04 + J07: run ``extractor`` only on ids not already extracted and keep
    old + new results.  Failed earlier results count as done unless
    ``retry_failed``."""
    if done is None:
        return extractor(todo)
    finished = done.where("extraction_success") if retry_failed else done
    new = todo.join(finished.select(id_field), id_field, "left_anti")
    return finished.unionByName(extractor(new))


def completeness_gate(stored: DataFrame, inputs: DataFrame, id_field: str = "jd_id") -> bool:
    """True when the stored results already cover every input id."""
    return stored.select(F.count_distinct(id_field)).first()[0] >= inputs.select(F.count_distinct(id_field)).first()[0]


def to_json_text(rec: Column) -> Column:
    """C06."""
    return F.to_json(rec)
