"""Checked queries: section parsing and structure statistics (F8 sectioned text)."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.operators import structure as S
from scriptorium.plans.registry import fx, query

FX = ("f_sectioned",)


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _rx_sql(patterns) -> str:
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns).replace("'", "''")


def _classify_sql(x: str) -> str:
    whens = " ".join(
        f"WHEN regexp_matches(lower({x}), '{_rx_sql(p)}') THEN '{t}'" for t, p in S.STANDARD_SECTIONS.items()
    )
    return f"CASE {whens} ELSE 'other' END"


def _known_sql() -> str:
    parts = []
    for k, (stype, pats) in enumerate(S.STANDARD_SECTIONS.items()):
        parts.append(
            f"""SELECT jd_id, off + hit AS start, {2 + k} AS prio, off + hit + length(m) AS "end", {_strip_sql('m')} AS text, '{stype}' AS rule
FROM (SELECT jd_id, line, off, found[i] AS m, length(array_to_string(between[1:i], '')) + coalesce(length(array_to_string(found[1:i-1], '')), 0) AS hit
  FROM (SELECT jd_id, line, off, found, string_split_regex(line, '{_rx_sql(pats)}') AS between, unnest(range(1, len(found) + 1)) AS i
    FROM (SELECT jd_id, line, off, regexp_extract_all(line, '{_rx_sql(pats)}') AS found FROM lines)))
WHERE length({_strip_sql("substr(line, 1, CAST(hit AS BIGINT))")}) < 10"""
        )
    return "\nUNION ALL\n".join(parts)


PARSE_CTE = f"""lines AS (
  SELECT jd_id, jd_text, ln, line,
    CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY jd_id ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off
  FROM (SELECT jd_id, jd_text, unnest(string_split(jd_text, chr(10))) AS line,
          unnest(range(0, len(string_split(jd_text, chr(10))))) AS ln FROM f_sectioned)),
cands AS (
SELECT jd_id, off AS start, 0 AS prio, off + length(line) AS "end",
  {_strip_sql("regexp_extract(line, '^([A-Z][^:\\n]{2,50}):[ \\t]*$', 1)")} AS text, 'colon' AS rule
FROM lines WHERE regexp_full_match(line, '[A-Z][^:\\n]{{2,50}}:[ \\t]*')
UNION ALL
SELECT jd_id, off, 1, off + length(line), {_strip_sql('line')}, 'caps'
FROM lines WHERE regexp_full_match(line, '[A-Z][A-Z\\s]{{3,50}}') AND len(string_split_regex({_strip_sql('line')}, '\\s+')) <= 6
UNION ALL
{_known_sql()}),
hs AS (SELECT *, row_number() OVER (PARTITION BY jd_id ORDER BY start, prio) AS rn FROM cands),
nx AS (SELECT a.jd_id, a.rn, min(b.rn) AS nrn FROM hs a LEFT JOIN hs b ON a.jd_id = b.jd_id AND b.start >= a.start + 10 GROUP BY a.jd_id, a.rn),
ch AS (SELECT jd_id, rn FROM hs WHERE rn = 1
       UNION ALL SELECT nx.jd_id, nx.nrn FROM ch JOIN nx ON ch.jd_id = nx.jd_id AND ch.rn = nx.rn WHERE nx.nrn IS NOT NULL),
kept AS (SELECT hs.* FROM hs JOIN ch ON hs.jd_id = ch.jd_id AND hs.rn = ch.rn),
ks AS (SELECT k.*, lead(start) OVER (PARTITION BY jd_id ORDER BY start, prio) AS nstart,
         row_number() OVER (PARTITION BY jd_id ORDER BY start, prio) AS krn FROM kept k),
body AS (SELECT k.jd_id, k.text AS header,
    {_strip_sql('substr(d.jd_text, k."end" + 1, greatest(coalesce(k.nstart, length(d.jd_text)) - k."end", 0))')} AS content,
    k.start AS start_pos, coalesce(k.nstart, length(d.jd_text)) AS end_pos, {_classify_sql('k.text')} AS section_type
  FROM ks k JOIN f_sectioned d ON k.jd_id = d.jd_id),
pre AS (SELECT k.jd_id, 'preamble' AS header, {_strip_sql('substr(d.jd_text, 1, k.start)')} AS content, CAST(0 AS BIGINT) AS start_pos,
    k.start AS end_pos, 'summary' AS section_type FROM ks k JOIN f_sectioned d ON k.jd_id = d.jd_id WHERE k.krn = 1 AND k.start > 20),
unst AS (SELECT jd_id, 'content' AS header, {_strip_sql('jd_text')} AS content, CAST(0 AS BIGINT) AS start_pos, length(jd_text) AS end_pos,
    'unstructured' AS section_type FROM f_sectioned WHERE jd_text IS NOT NULL AND length(jd_text) > 0
    AND jd_id NOT IN (SELECT jd_id FROM cands)),
secs0 AS (SELECT * FROM body WHERE length(content) >= 20 UNION ALL SELECT * FROM pre WHERE length(content) >= 20 UNION ALL SELECT * FROM unst),
secs AS (SELECT *, row_number() OVER (PARTITION BY jd_id ORDER BY start_pos) - 1 AS ord FROM secs0),
pats AS (SELECT d.jd_id, coalesce(string_agg(s.section_type, ' -> ' ORDER BY s.ord), '') AS pattern, count(s.ord) AS n
  FROM f_sectioned d LEFT JOIN secs s ON d.jd_id = s.jd_id GROUP BY d.jd_id)"""


def W(body: str) -> str:
    return f"WITH RECURSIVE {PARSE_CTE}\n{body}"


def _doc(spark, sf):
    return fx(spark, sf, "f_sectioned")


def _parsed(spark, sf):
    return S.parse_structure(_doc(spark, sf))


def _sections(spark, sf):
    return S.parse_corpus(_doc(spark, sf))


def _cands(spark, sf, rule=None, deduped=False):
    h = S.headers_table(_doc(spark, sf), deduped=deduped)
    return h.where(F.col("rule") == rule) if rule else h


@query("g01_header_colon", W("SELECT jd_id, start, text FROM cands WHERE rule = 'colon'"), FX)
def q_g01(spark, sf):
    return _cands(spark, sf, "colon").select("jd_id", "start", "text")


@query("g02_header_caps", W("SELECT jd_id, start, text FROM cands WHERE rule = 'caps'"), FX)
def q_g02(spark, sf):
    return _cands(spark, sf, "caps").select("jd_id", "start", "text")


@query("g03_header_known", W("SELECT jd_id, start, rule, text FROM cands WHERE rule NOT IN ('colon', 'caps')"), FX)
def q_g03(spark, sf):
    return _cands(spark, sf).where(~F.col("rule").isin("colon", "caps")).select("jd_id", "start", "rule", "text")


@query(
    "g04_custom_patterns",
    W("SELECT section_type, CAST(count(*) AS BIGINT) AS count FROM secs GROUP BY 1"),
    FX,
)
def q_g04(spark, sf):
    # a custom type appended after the standard ones; the fixture texts hold
    # none of its phrases, so the result must equal the standard parse
    # (its matching is covered by tests/test_structure.py)
    extra = {"closing": [r"thank\s+you", r"equal\s+opportunity"]}
    return S.section_frequency(S.parse_corpus(_doc(spark, sf), custom_patterns=extra))


@query("g05_header_dedupe", W("SELECT jd_id, start, prio, text FROM kept"), FX)
def q_g05(spark, sf):
    return _cands(spark, sf, deduped=True).select("jd_id", "start", "prio", "text")


@query("g06_classify_header", W(f"SELECT DISTINCT text AS header, {_classify_sql('text')} AS section_type FROM cands"), FX)
def q_g06(spark, sf):
    h = _cands(spark, sf).select(F.col("text").alias("header")).distinct()
    return h.select("header", S.classify_header(F.col("header")).alias("section_type"))


@query(
    "g07_cut_sections",
    W("SELECT jd_id, header, content, start_pos, end_pos FROM secs WHERE header NOT IN ('preamble', 'content') OR section_type NOT IN ('summary', 'unstructured')"),
    FX,
)
def q_g07(spark, sf):
    s = _sections(spark, sf)
    cond = ~F.col("header").isin("preamble", "content") | ~F.col("section_type").isin("summary", "unstructured")
    return s.where(cond).select("jd_id", "header", "content", "start_pos", "end_pos")


@query("g08_preamble", W("SELECT jd_id, content, end_pos FROM secs WHERE header = 'preamble' AND section_type = 'summary' AND start_pos = 0 AND ord = 0"), FX)
def q_g08(spark, sf):
    s = _sections(spark, sf)
    return s.where((F.col("header") == "preamble") & (F.col("section_type") == "summary") & (F.col("start_pos") == 0) & (F.col("ord") == 0)).select(
        "jd_id", "content", "end_pos"
    )


@query("g09_unstructured", W("SELECT jd_id, content, end_pos FROM secs WHERE section_type = 'unstructured'"), FX)
def q_g09(spark, sf):
    return _sections(spark, sf).where(F.col("section_type") == "unstructured").select("jd_id", "content", "end_pos")


@query(
    "g10_parse_corpus",
    W("SELECT jd_id, CAST(ord AS INT) AS ord, header, content, start_pos, end_pos, section_type FROM secs"),
    FX,
)
def q_g10(spark, sf):
    return _sections(spark, sf)


@query(
    "g11_section_lookup",
    W(
        """SELECT d.jd_id, (SELECT count(*) FROM secs s WHERE s.jd_id = d.jd_id AND contains(lower(s.header), 'responsibilities')) > 0 AS has_section,
  (SELECT s.content FROM secs s WHERE s.jd_id = d.jd_id AND contains(lower(s.header), 'responsibilities') ORDER BY s.ord LIMIT 1) AS section_content
FROM f_sectioned d"""
    ),
    FX,
)
def q_g11(spark, sf):
    return S.section_lookup(_parsed(spark, sf), "Responsibilities").select("jd_id", "has_section", "section_content")


@query("w01_running_offset", W("SELECT jd_id, CAST(ln AS INT) AS ln, CAST(off AS BIGINT) AS offset FROM lines"), FX)
def q_w01(spark, sf):
    return S.line_offsets(_doc(spark, sf))


@query(
    "w02_next_header",
    W("SELECT jd_id, start, CAST(lead(start) OVER (PARTITION BY jd_id ORDER BY start, prio) AS DOUBLE) AS next_start FROM kept"),
    FX,
)
def q_w02(spark, sf):
    # next_start is NULL for the last header: reported as DOUBLE in both engines
    return S.next_header(_cands(spark, sf, deduped=True)).withColumn("next_start", F.col("next_start").cast("double"))


@query("a19_section_frequency", W("SELECT section_type, CAST(count(*) AS BIGINT) AS count FROM secs GROUP BY 1"), FX)
def q_a19(spark, sf):
    return S.section_frequency(_sections(spark, sf))


@query(
    "a20_section_coverage",
    W("SELECT section_type, round(count(DISTINCT jd_id) / (SELECT count(*) FROM f_sectioned), 3) AS coverage FROM secs GROUP BY 1"),
    FX,
)
def q_a20(spark, sf):
    return S.section_coverage(_parsed(spark, sf))


@query("a21_structure_patterns", W("SELECT pattern, CAST(count(*) AS BIGINT) AS count FROM pats GROUP BY 1 HAVING count(*) >= 5"), FX)
def q_a21(spark, sf):
    return S.structure_patterns(_parsed(spark, sf), 5)


@query("f08_min_support", W("SELECT pattern, CAST(count(*) AS BIGINT) AS count FROM pats GROUP BY 1 HAVING count(*) >= 2"), FX)
def q_f08(spark, sf):
    return S.structure_patterns(_parsed(spark, sf), 2)


_EXP = ", ".join(
    f"coalesce((SELECT round(count(DISTINCT jd_id) / (SELECT count(*) FROM f_sectioned), 3) FROM secs WHERE section_type = '{t}'), 0.0) AS coverage_{t}"
    for t in S.EXPECTED_SECTIONS
)


@query(
    "a22_structure_consistency",
    W(
        f"""SELECT CAST(count(*) AS BIGINT) AS total_jds, CAST(min(n) AS BIGINT) AS min_sections, CAST(max(n) AS BIGINT) AS max_sections,
  round(avg(n), 2) AS mean_sections,
  CAST((SELECT n FROM pats ORDER BY n LIMIT 1 OFFSET (SELECT count(*) // 2 FROM pats)) AS BIGINT) AS median_sections,
  CAST((SELECT count(*) FROM (SELECT pattern FROM pats GROUP BY 1 HAVING count(*) >= 5)) AS BIGINT) AS unique_structures,
  round(coalesce((SELECT max(c) FROM (SELECT count(*) AS c FROM pats GROUP BY pattern HAVING count(*) >= 5)) / count(*), 0.0), 3) AS top_structure_coverage,
  {_EXP}
FROM pats"""
    ),
    FX,
)
def q_a22(spark, sf):
    return S.structure_consistency(_parsed(spark, sf))


_TYPES = S.all_section_types()


@query(
    "a23_structure_vectors",
    W(
        "SELECT d.jd_id, "
        + ", ".join(
            f"CAST((SELECT count(*) FROM secs s WHERE s.jd_id = d.jd_id AND s.section_type = '{t}') > 0 AS INT) AS {t}" for t in _TYPES
        )
        + " FROM f_sectioned d"
    ),
    FX,
)
def q_a23(spark, sf):
    return S.structure_vectors(_parsed(spark, sf))


_EMBED_TYPES = ["summary", "responsibilities", "required_qualifications", "benefits"]
_F05 = f"""f5 AS (SELECT * FROM secs WHERE section_type IN ({', '.join(repr(t) for t in _EMBED_TYPES)}) AND length(content) >= 50),
f5k AS (SELECT * FROM f5 WHERE section_type IN (SELECT section_type FROM f5 GROUP BY 1 HAVING count(*) >= 2))"""


def _w_f05(body: str) -> str:
    return f"WITH RECURSIVE {PARSE_CTE},\n{_F05}\n{body}"


@query("f05_section_filter", _w_f05("SELECT jd_id, section_type, CAST(length(content) AS BIGINT) AS n FROM f5k"), FX)
def q_f05(spark, sf):
    s = S.section_filter(_sections(spark, sf), _EMBED_TYPES)
    return s.select("jd_id", "section_type", F.length("content").cast("bigint").alias("n"))


@query("a54_section_counts", _w_f05("SELECT section_type, CAST(count(*) AS BIGINT) AS count FROM f5k GROUP BY 1"), FX)
def q_a54(spark, sf):
    return S.section_counts(S.section_filter(_sections(spark, sf), _EMBED_TYPES))


@query(
    "f10_small_group_gate",
    _w_f05("SELECT section_type, CAST(count(*) AS BIGINT) AS n, CAST(least(10, greatest(2, floor(count(*) / 5))) AS BIGINT) AS k FROM f5k GROUP BY 1 HAVING count(*) >= 10"),
    FX,
)
def q_f10(spark, sf):
    return S.cluster_gate(S.section_filter(_sections(spark, sf), _EMBED_TYPES))


_M03_TYPES = ["summary", "responsibilities", "benefits"]


@query(
    "m03_concat_sections",
    W(
        """, sv AS (SELECT jd_id, section_type, ord, [CAST(length(content) AS BIGINT), CAST(len(string_split(content, ' ')) AS BIGINT)] AS vec FROM secs),
last AS (SELECT jd_id, section_type, arg_max(vec, ord) AS vec FROM sv GROUP BY 1, 2)
SELECT d.jd_id, array_to_string(list_concat(
  coalesce((SELECT vec FROM last l WHERE l.jd_id = d.jd_id AND section_type = 'summary'), [0, 0]),
  coalesce((SELECT vec FROM last l WHERE l.jd_id = d.jd_id AND section_type = 'responsibilities'), [0, 0]),
  coalesce((SELECT vec FROM last l WHERE l.jd_id = d.jd_id AND section_type = 'benefits'), [0, 0])), ',') AS features
FROM f_sectioned d"""
    ).replace("\n, sv AS", ",\nsv AS"),
    FX,
)
def q_m03(spark, sf):
    secs = _sections(spark, sf)
    # precomputed per-section vectors: (characters, blank-separated words)
    sv = secs.select("jd_id", "section_type", "ord", F.array(F.length("content").cast("double"), F.size(F.split("content", " ")).cast("double")).alias("vec"))
    out = S.concat_section_vectors(sv, _doc(spark, sf).select(F.col("jd_id").cast("string")), _M03_TYPES, 2)
    return out.select("jd_id", F.array_join(F.transform("features", lambda x: x.cast("bigint").cast("string")), ",").alias("features"))
