"""Section parsing of free text and structure statistics.

The parser is one projection per document built from array functions:

1. the text is split into lines; every line is tested against the colon
   rule, the capitals rule and the known section patterns
   (``regexp_instr`` gives the position of a known pattern in the line);
2. candidate headers get their absolute offset (length of the text before
   their line), are sorted by (start, rule priority) and folded left to right,
   keeping a header only when it starts at least 10 characters after the last
   kept one;
3. sections are cut between consecutive kept headers, stripped and kept when
   long enough; a preamble and the no-header case are added.

No step groups rows, so the parse is a map-only stage: no text is shuffled, and
a corpus of any size parses in one pass with documents spread over all tasks.

Differences to a whole-text regex scan, by design: rules are applied line by
line, so a capitals header or a known pattern that would run across a line
break is not found, and only the first match of a known pattern per line is
considered (a second one would start within the 10-character dedupe window in
all but contrived lines).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.arrays import let, scan

from scriptorium.functions.numeric import rnd
from scriptorium.session import written

# --- fixed values (must equal the reference for equal results) -------------
# Section types in order, each with its header patterns (case-insensitive).
STANDARD_SECTIONS = {
    "summary": [
        r"(?:job\s+)?(?:summary|overview|description|about\s+(?:the\s+)?(?:role|position|job))",
        r"position\s+summary",
        r"role\s+(?:summary|overview)",
    ],
    "responsibilities": [
        r"(?:key\s+)?responsibilities",
        r"(?:job\s+)?duties",
        r"what\s+you(?:'ll|\s+will)\s+do",
        r"your\s+responsibilities",
        r"the\s+role",
        r"accountabilities",
    ],
    "required_qualifications": [
        r"(?:required|minimum|basic)\s+qualifications",
        r"requirements",
        r"what\s+you(?:'ll|\s+will)\s+(?:need|bring)",
        r"must\s+have",
        r"required\s+(?:skills|experience)",
        r"you\s+have",
    ],
    "preferred_qualifications": [
        r"(?:preferred|desired|nice\s+to\s+have)\s+qualifications",
        r"preferred\s+(?:skills|experience)",
        r"bonus\s+(?:points|qualifications)",
        r"it(?:'s|\s+is)\s+a\s+plus",
        r"ideally",
    ],
    "education": [
        r"education(?:al)?\s+(?:requirements?|background)",
        r"degree\s+requirements?",
    ],
    "experience": [
        r"(?:work\s+)?experience",
        r"years?\s+(?:of\s+)?experience",
    ],
    "skills": [
        r"(?:required\s+|key\s+)?skills",
        r"technical\s+skills",
        r"competenc(?:y|ies)",
    ],
    "benefits": [
        r"benefits",
        r"what\s+we\s+offer",
        r"perks",
        r"compensation",
    ],
    "team_info": [
        r"(?:about\s+)?(?:the\s+)?team",
        r"who\s+we\s+are",
        r"our\s+team",
    ],
    "company_info": [
        r"(?:about\s+)?(?:the\s+)?company",
        r"about\s+us",
        r"who\s+we\s+are",
    ],
    "location": [
        r"location",
        r"work\s+location",
        r"where\s+you(?:'ll|\s+will)\s+work",
    ],
    "application": [
        r"how\s+to\s+apply",
        r"application\s+(?:process|instructions?)",
        r"to\s+apply",
    ],
}
# Line rules: a line ending in a colon, and a line of capitals (at most 6 words).
CAPS_MAX_WORDS = 6
MIN_SECTION_LENGTH = 20
HEADER_TOLERANCE = 10
PREFIX_LIMIT = 10
EXPECTED_SECTIONS = ["responsibilities", "required_qualifications", "summary"]
MIN_SUPPORT = 5
MIN_EMBED_CONTENT = 50
# ---------------------------------------------------------------------------

_BLANK = "\\s\\x{1c}-\\x{1f}"
_STRIP = f"^(?U)[{_BLANK}]+|(?U)[{_BLANK}]+$"
# Java forms of the line rules: the line has no '\n', so '$' becomes '\z'
# (Java's '$' would also stop before a final '\r').
_COLON_J = "^([A-Z][^:\\n]{2,50}):[ \\t]*\\z"
_CAPS_J = f"(?U)^[A-Z][A-Z{_BLANK}]{{3,50}}\\z"


def section_patterns(custom_patterns: dict[str, list[str]] | None = None) -> dict[str, list[str]]:
    """Standard types with custom ones merged (same name replaces, new ones appended)."""
    pats = dict(STANDARD_SECTIONS)
    pats.update(custom_patterns or {})
    return pats


def combined_regex(patterns: list[str]) -> str:
    return "(?iU)" + "|".join(f"(?:{p})" for p in patterns)


def strip(c: Column) -> Column:
    """Python ``str.strip()``."""
    return F.regexp_replace(c, _STRIP, "")


def classify_header(header: Column, custom_patterns=None) -> Column:
    """First type (in order) whose patterns occur in the lower-cased header."""
    out = None
    low = F.lower(header)
    for stype, pats in section_patterns(custom_patterns).items():
        cond = low.rlike(combined_regex(pats))
        out = F.when(cond, F.lit(stype)) if out is None else out.when(cond, F.lit(stype))
    return out.otherwise(F.lit("other"))


def text_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_starts(lines: Column) -> Column:
    """Character offset of every line of a split text."""
    return scan(F.transform(lines, lambda x: F.length(x).cast("bigint") + 1), F.lit(0).cast("bigint"), lambda at, n: (at + n, F.array(at)))


def header_candidates(lines: Column, custom_patterns=None) -> Column:
    """Header candidates of a text's lines, as struct(start, prio, end,
    text, rule, ln, pos, len); the last three place the match inside its line.

    prio orders ties on the same start: 0 colon, 1 capitals, 2.. known types
    in pattern order (the stable order of the three strategies).  Catalyst
    does not share common subexpressions inside lambdas, so each regex runs
    once per line in a first pass and later passes read its result.
    """
    types = list(section_patterns(custom_patterns).items())

    # A known phrase counts only near the start of its line, so one anchored
    # test over all phrases spares the other lines the test of every type.
    near_any = f"(?isU)^[{_BLANK}]*.{{0,{PREFIX_LIMIT - 1}}}?[{_BLANK}]*(?:" + "|".join(f"(?:{p})" for _, ps in types for p in ps) + ")"

    # pass 1: one evaluation of every rule per line
    def probe(line: Column, i: Column) -> Column:
        return F.struct(
            line.alias("line"),
            i.alias("ln"),
            line.rlike(_COLON_J).alias("colon"),
            line.rlike(_CAPS_J).alias("caps"),
            line.rlike(near_any).alias("near"),
        )

    # every match of a type in a line, with its place; a match near the start
    # has fewer than PREFIX_LIMIT matches before it
    def matches(line: Column, rule: str, prio: int, pats: list[str], i: Column) -> Column:
        rx = combined_regex(pats)

        def total(texts: Column, k: Column) -> Column:
            return F.aggregate(F.slice(texts, F.lit(1), k), F.lit(0), lambda n, x: n + F.length(x))

        def place(w: Column) -> Column:
            found = F.transform(w["found"], lambda m, k: F.struct(m.alias("m"), (total(w["between"], k + 1) + total(w["found"], k)).alias("pos")))
            near = F.filter(found, lambda x: F.length(strip(line.substr(F.lit(1), x["pos"]))) < PREFIX_LIMIT)
            return F.transform(
                near,
                lambda x: F.struct(i.alias("ln"), x["pos"].alias("pos"), F.lit(prio).alias("prio"), F.length(x["m"]).alias("len"),
                                   strip(x["m"]).alias("text"), F.lit(rule).alias("rule")),
            )

        found = F.slice(F.regexp_extract_all(line, F.lit(rx), F.lit(0)), 1, PREFIX_LIMIT)
        return let(F.struct(found.alias("found"), F.split(line, rx, PREFIX_LIMIT + 1).alias("between")), place)

    # pass 2: candidates of a line, texts extracted only where a rule fired
    def per_line(x: Column) -> Column:
        line, i = x["line"], x["ln"]
        cands = [
            F.when(
                x["colon"],
                F.struct(i.alias("ln"), F.lit(0).alias("pos"), F.lit(0).alias("prio"), F.length(line).alias("len"),
                         strip(F.regexp_extract(line, _COLON_J, 1)).alias("text"), F.lit("colon").alias("rule")),
            ),
            F.when(
                x["caps"] & (F.size(F.split(strip(line), f"(?U)[{_BLANK}]+")) <= CAPS_MAX_WORDS),
                F.struct(i.alias("ln"), F.lit(0).alias("pos"), F.lit(1).alias("prio"), F.length(line).alias("len"),
                         strip(line).alias("text"), F.lit("caps").alias("rule")),
            ),
        ]
        ruled = F.filter(F.array(*cands), lambda c: c.isNotNull())
        known = F.concat(*[matches(line, stype, 2 + k, pats, i) for k, (stype, pats) in enumerate(types)])
        return F.when(x["near"], F.concat(ruled, known)).otherwise(ruled)

    # pass 3: absolute offsets, from the starts of the lines
    def placed(starts: Column) -> Column:
        return F.transform(
            F.flatten(F.transform(F.transform(lines, probe), per_line)),
            lambda c: let(
                F.get(starts, c["ln"]),
                lambda off: F.struct(
                    (off + c["pos"]).cast("bigint").alias("start"),
                    c["prio"].alias("prio"),
                    (off + c["pos"] + c["len"]).cast("bigint").alias("end"),
                    c["text"].alias("text"),
                    c["rule"].alias("rule"),
                    c["ln"].alias("ln"),
                    c["pos"].alias("pos"),
                    c["len"].alias("len"),
                ),
            ),
        )

    return let(line_starts(lines), placed)


def dedupe_headers(cands: Column, tolerance: int = HEADER_TOLERANCE) -> Column:
    """Sort by (start, prio); keep a header when it starts >= tolerance after the last kept one."""
    def step(last, h):
        keep = h["start"] - last >= tolerance
        return F.when(keep, h["start"]).otherwise(last), F.filter(F.array(h), lambda _: keep)

    return scan(F.array_sort(cands), F.lit(-(10**9)).cast("bigint"), step)


def sections_from_kept(text: Column, lines: Column, kept: Column, custom_patterns=None, min_section_length: int = MIN_SECTION_LENGTH) -> Column:
    """G06-G09 for one text, given its lines and kept headers (column references).

    A section is joined from its lines: cutting it out of the text by character
    offset would read the text from its start for every header.  Returns array<struct<header, content, start_pos, end_pos, section_type>>.
    """
    n = F.length(text).cast("bigint")

    def cut(h, j):
        nxt = F.try_element_at(kept, j + 2)
        end_c = F.coalesce(nxt["start"], n)
        line, after = F.get(lines, h["ln"]), h["pos"] + h["len"] + 1
        to_line = F.coalesce(nxt["ln"], F.size(lines))
        middle = F.slice(lines, h["ln"] + 2, F.greatest(to_line - h["ln"] - 1, F.lit(0)))
        head = F.when(nxt.isNull(), F.filter(F.array(line), lambda _: F.lit(False))).otherwise(F.array(F.get(lines, nxt["ln"]).substr(F.lit(1), nxt["pos"])))
        content = strip(
            F.when(to_line == h["ln"], line.substr(after, F.greatest(nxt["pos"] - after + 1, F.lit(0)))).otherwise(
                F.array_join(F.concat(F.array(line.substr(after, F.length(line))), middle, head), "\n")
            )
        )
        return F.struct(
            h["text"].alias("header"),
            content.alias("content"),
            h["start"].alias("start_pos"),
            end_c.alias("end_pos"),
            classify_header(h["text"], custom_patterns).alias("section_type"),
        )

    body = F.filter(F.transform(kept, cut), lambda s: F.length(s["content"]) >= min_section_length)
    first = F.try_element_at(kept, F.lit(1))["start"]
    pre_text = strip(text.substr(F.lit(1), first))
    pre = F.struct(
        F.lit("preamble").alias("header"),
        pre_text.alias("content"),
        F.lit(0).cast("bigint").alias("start_pos"),
        first.alias("end_pos"),
        F.lit("summary").alias("section_type"),
    )
    with_pre = F.when(
        (first > min_section_length) & (F.length(pre_text) >= min_section_length), F.concat(F.array(pre), body)
    ).otherwise(body)
    whole = F.array(
        F.struct(
            F.lit("content").alias("header"),
            strip(text).alias("content"),
            F.lit(0).cast("bigint").alias("start_pos"),
            n.alias("end_pos"),
            F.lit("unstructured").alias("section_type"),
        )
    )
    return (
        F.when(text.isNull() | (n == 0), F.filter(body, lambda s: F.lit(False)))
        .when(F.size(kept) == 0, whole)
        .otherwise(with_pre)
    )


def parse_structure(
    df: DataFrame,
    text_field: str = "jd_text",
    id_field: str = "jd_id",
    custom_patterns=None,
    min_section_length: int = MIN_SECTION_LENGTH,
    squeeze_first: bool = False,
) -> DataFrame:
    """(id, sections array) per document. ``squeeze_first`` reproduces the
    reference order (whitespace squeezed by the cleaner before parsing).

    The kept-header array is bound once with ``let`` and read by every section.
    """
    t = F.col(text_field)
    if squeeze_first:
        from scriptorium.functions.text import squeeze_whitespace

        t = squeeze_whitespace(t)

    def parsed(lines: Column) -> Column:
        kept = dedupe_headers(header_candidates(lines, custom_patterns))
        return let(kept, lambda k: sections_from_kept(F.col("_t"), lines, k, custom_patterns, min_section_length))

    sections = let(text_lines(F.col("_t")), parsed)
    return df.select(F.col(id_field).cast("string").alias(id_field), t.alias("_t")).select(id_field, sections.alias("sections"))


def parse_corpus(df: DataFrame, text_field: str = "jd_text", id_field: str = "jd_id", **kw) -> DataFrame:
    """Long table sections(jd_id, ord, header, content, start_pos, end_pos, section_type).

    One ``inline`` generator emits all columns, so no field extraction is
    pushed into (and duplicated inside) the generator input.
    """
    p = parse_structure(df, text_field, id_field, **kw)
    rows = F.transform(
        "sections",
        lambda s, i: F.struct(
            i.alias("ord"), s["header"].alias("header"), s["content"].alias("content"), s["start_pos"].alias("start_pos"),
            s["end_pos"].alias("end_pos"), s["section_type"].alias("section_type"),
        ),
    )
    return p.select(id_field, F.inline(rows))


def headers_table(df: DataFrame, text_field: str = "jd_text", id_field: str = "jd_id", deduped: bool = False, custom_patterns=None) -> DataFrame:
    """Header candidates (G01-G03) or kept headers (G05) as rows."""

    def headers(lines: Column) -> Column:
        c = header_candidates(lines, custom_patterns)
        return dedupe_headers(c) if deduped else c

    arr = let(text_lines(F.col(text_field)), headers)
    return df.select(F.col(id_field).cast("string").alias(id_field), F.explode(arr).alias("h")).select(id_field, "h.start", "h.prio", "h.end", "h.text", "h.rule")


def line_offsets(df: DataFrame, text_field: str = "jd_text", id_field: str = "jd_id") -> DataFrame:
    """Character offset of each line (running sum of length + 1 per document)."""
    lines = df.select(id_field, F.posexplode(text_lines(F.col(text_field))).alias("ln", "line"))
    w = Window.partitionBy(id_field).orderBy("ln").rowsBetween(Window.unboundedPreceding, -1)
    return lines.select(
        id_field, F.col("ln").cast("int").alias("ln"), F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0)).cast("bigint").alias("offset")
    )


def next_header(headers: DataFrame, id_field: str = "jd_id") -> DataFrame:
    """Start of the next kept header per document (NULL for the last)."""
    w = Window.partitionBy(id_field).orderBy("start", "prio")
    return headers.select(id_field, "start", F.lead("start").over(w).alias("next_start"))


def section_lookup(parsed: DataFrame, pattern: str, id_field: str = "jd_id") -> DataFrame:
    """has_section / get_section_content / section_names per document."""
    p = pattern.lower()
    hit = F.filter("sections", lambda s: F.instr(F.lower(s["header"]), p) > 0)
    return parsed.select(
        id_field,
        (F.size(hit) > 0).alias("has_section"),
        F.try_element_at(hit, F.lit(1))["content"].alias("section_content"),
        F.array_join(F.transform("sections", lambda s: s["header"]), " | ").alias("section_names"),
    )


# ---------------------------------------------------------------- statistics

def section_frequency(sections: DataFrame) -> DataFrame:
    """A19."""
    return sections.groupBy("section_type").agg(F.count(F.lit(1)).cast("bigint").alias("count"))


def pattern_counts(parsed: DataFrame) -> DataFrame:
    """Documents per ordered type sequence (the only shuffle of the structure
    statistics: one small row per distinct pattern after partial aggregation).
    Documents without sections have the empty pattern."""
    return parsed.groupBy(_pattern(parsed).alias("pattern")).agg(F.count(F.lit(1)).alias("docs"))


def _pattern_types(c: Column) -> Column:
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, " -> "))


def section_coverage(parsed: DataFrame, id_field: str = "jd_id") -> DataFrame:
    """Share of documents (3 dp) having each type; documents with no
    section count in the total. Derived from the pattern table, so the corpus
    is parsed once."""
    pc = pattern_counts(parsed)
    total = pc.select(F.sum("docs")).scalar()
    t = pc.select(F.explode(F.array_distinct(_pattern_types(F.col("pattern")))).alias("section_type"), "docs")
    return t.groupBy("section_type").agg(rnd(F.sum("docs") / total, 3).alias("coverage"))


def _pattern(parsed: DataFrame) -> Column:
    return F.array_join(F.transform("sections", lambda s: s["section_type"]), " -> ")


def structure_patterns(parsed: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    """Ordered type sequence per document, counted, count >= min_support."""
    return pattern_counts(parsed).where(F.col("docs") >= min_support).select(
        "pattern", F.col("docs").cast("bigint").alias("count")
    )


def structure_consistency(parsed: DataFrame) -> DataFrame:
    """One row. Median is the upper median (sorted[n // 2]) as in the reference.

    Everything comes from the pattern table (section count = length of the
    pattern), computed once: a window over that small table (one row per
    distinct pattern) gives the running document count, and one aggregate
    reads the statistics and the upper median from it.  The corpus is parsed
    once and no document list is sorted.
    """
    pc = pattern_counts(parsed).withColumn("n", F.size(_pattern_types(F.col("pattern"))))
    whole = Window.partitionBy()
    running = Window.partitionBy().orderBy("n", "pattern").rowsBetween(Window.unboundedPreceding, 0)
    pc = pc.withColumn("_total", F.sum("docs").over(whole)).withColumn("_cum", F.sum("docs").over(running))
    supported = F.col("docs") >= MIN_SUPPORT
    types = _pattern_types(F.col("pattern"))
    return pc.agg(
        F.sum("docs").cast("bigint").alias("total_jds"),
        F.min("n").cast("bigint").alias("min_sections"),
        F.max("n").cast("bigint").alias("max_sections"),
        rnd(F.sum(F.col("n") * F.col("docs")) / F.sum("docs"), 2).alias("mean_sections"),
        F.min(F.when(F.col("_cum") >= F.floor(F.col("_total") / 2) + 1, F.col("n"))).cast("bigint").alias("median_sections"),
        F.count_if(supported).cast("bigint").alias("unique_structures"),
        rnd(F.coalesce(F.max(F.when(supported, F.col("docs"))) / F.sum("docs"), F.lit(0.0)), 3).alias("top_structure_coverage"),
        *[
            rnd(F.sum(F.when(F.array_contains(types, t), F.col("docs")).otherwise(0)) / F.sum("docs"), 3).alias(f"coverage_{t}")
            for t in EXPECTED_SECTIONS
        ],
    )


def all_section_types(custom_patterns=None) -> list[str]:
    return sorted(set(section_patterns(custom_patterns)) | {"other", "unstructured"})


def structure_vectors(parsed: DataFrame, id_field: str = "jd_id", types: list[str] | None = None) -> DataFrame:
    """0/1 column per section type (sorted), computed per document without a pivot shuffle."""
    types = types or all_section_types()
    st = F.transform("sections", lambda s: s["section_type"])
    return parsed.select(id_field, *[F.array_contains(st, t).cast("int").alias(t) for t in types])


def section_filter(sections: DataFrame, section_types: list[str], min_content_length: int = MIN_EMBED_CONTENT) -> DataFrame:
    """requested types with content >= min length; a type with < 2 rows is dropped.

    The rows are written once, so that texts are parsed once and none is dealt by its
    type; at most as many counts as requested types reach the driver.
    """
    keep = written(sections.where(F.col("section_type").isin(section_types) & (F.length("content") >= min_content_length)), "sections")
    counts = keep.groupBy("section_type").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2").collect()
    return keep.where(F.col("section_type").isin([r["section_type"] for r in counts]))


def section_counts(sections: DataFrame) -> DataFrame:
    """Rows per section type to embed."""
    return sections.groupBy("section_type").agg(F.count(F.lit(1)).cast("bigint").alias("count"))


def structure_cluster_profile(vectors: DataFrame, assignments: DataFrame, types: list[str], id_field: str = "jd_id") -> DataFrame:
    """Per cluster size, share (3 dp), mean presence per type (2 dp), types present in > 50 %."""
    j = vectors.join(assignments, id_field)
    total = j.select(F.count(F.lit(1))).scalar()
    g = j.groupBy("cluster").agg(F.count(F.lit(1)).cast("bigint").alias("size"), *[F.avg(t).alias(t) for t in types])
    common = F.filter(
        F.array(*[F.when(F.col(t) > 0.5, F.lit(t)) for t in types]), lambda x: x.isNotNull()
    )
    return g.select(
        "cluster",
        "size",
        rnd(F.col("size") / total, 3).alias("percentage"),
        F.array_join(common, ",").alias("common_sections"),
        *[rnd(t, 2).alias(f"presence_{t}") for t in types],
    )


def cluster_gate(sections: DataFrame, min_rows: int = 10) -> DataFrame:
    """section types with at least ``min_rows`` rows and their k =
    min(10, max(2, n // 5))."""
    c = sections.groupBy("section_type").agg(F.count(F.lit(1)).cast("bigint").alias("n")).where(F.col("n") >= min_rows)
    return c.select("section_type", "n", F.least(F.lit(10), F.greatest(F.lit(2), F.floor(F.col("n") / 5))).cast("bigint").alias("k"))


def concat_section_vectors(sec_vecs: DataFrame, docs: DataFrame, types: list[str], dim: int, id_field: str = "jd_id") -> DataFrame:
    """Per document the vectors of ``types`` concatenated in that order;
    a missing type gives a zero vector, a repeated type its later section.

    ``sec_vecs`` is (id, section_type, ord, vec); the pivot runs over the
    caller's type list (bounded), one group per document.
    """
    zeros = F.array_repeat(F.lit(0.0), dim)
    p = (
        sec_vecs.where(F.col("section_type").isin(types))
        .groupBy(id_field)
        .pivot("section_type", types)
        .agg(F.max_by(F.col("vec").cast("array<double>"), F.col("ord")))
    )
    j = docs.select(id_field).join(p, id_field, "left")
    return j.select(id_field, F.concat(*[F.coalesce(F.col(t), zeros) for t in types]).alias("features"))
