"""The checked queries ``opN_<name>``: one operator each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.bpe import encode_documents
from scriptorium.llm.context_mixing import score_texts
from scriptorium.llm.filter_audit import audit_documents
from scriptorium.llm.line_dedup import dedup_lines
from scriptorium.llm.mixing import mix
from scriptorium.llm.prefix_forest import nearest
from scriptorium.llm.prefix_trie import prefix_trie
from scriptorium.llm.ranking import score_quality
from scriptorium.llm.registry import ORACLE, QUERIES, query
from scriptorium.llm.sharding import shard_documents
from scriptorium.llm.shingle_join import jaccard_components
from scriptorium.llm.suffix_dedup import cut_repeats
from scriptorium.llm.syncmers import compare_with_edits, fingerprint_text
from scriptorium.llm.token_files import read_token_files, write_token_files
from scriptorium.sources.tables import table

__all__ = ["ORACLE", "QUERIES"]


def id_crc() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary"))


def file_block(rows: int, blocks: int) -> Column:
    """Blocks of neighbouring rows of a file."""
    return F.pmod(F.xxhash64("_metadata.file_path", F.floor(F.col("_metadata.row_index") / rows)), F.lit(blocks))


@query("op1_shard_lpt")
def op1_shard_lpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op2_byte_bpe")
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    CAST(concat('0x', substr(md5(COALESCE(CAST(doc_id AS VARCHAR), '')), 1, 15)) AS BIGINT) AS h
  FROM documents),
s AS (
  SELECT source, SUM(size) AS source_size, 1 + (ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w
  FROM d GROUP BY source),
-- With the first j sources (by size a weight) at their cap, the others share the rest; the level is the highest of these.
o AS (
  SELECT *,
    SUM(source_size) OVER () - COALESCE(SUM(3.0 * source_size) OVER (ORDER BY 1.0 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_words,
    SUM(w) OVER (ORDER BY 1.0 * source_size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight
  FROM s),
level AS (SELECT MAX(left_words / left_weight) AS l FROM o),
t AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size, LEAST(3.0 * source_size, w * COALESCE(l, 0)) AS target FROM s, level),
r AS (
  SELECT *, CASE WHEN source_size > 0 THEN FLOOR(target / source_size) ELSE 0 END AS k FROM t),
c AS (
  SELECT d.doc_id, d.size, r.source_size, r.target, r.k, r.target - r.k * r.source_size AS rest,
    SUM(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    SUM(d.size) OVER (PARTITION BY d.source, d.h) AS here
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (k + CASE WHEN upto <= rest OR (upto - here <= rest AND 2 * (rest - upto + here) >= here) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""


@query("op3_mix", OP3_SQL)
def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"), weights=(1, 2, 3), most=3.0)
    return out.select("doc_id", "size", "source_size", "target", "taken")


@query("op4_pairwise_quality")
def op4_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), id_crc() % 5 == 0, cut_score=0.3)


OP5_SQL = r"""
WITH l AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
w AS (
  SELECT DISTINCT line, list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM l
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
f AS (SELECT line, MIN(struct_pack(d := doc_id, a := pos)) AS first FROM l GROUP BY line),
s AS (
  SELECT line, list_distinct(CASE WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' ')) END) AS tokens FROM w),
t AS (SELECT line, len(tokens) AS n, unnest(tokens) AS token FROM s),
m AS (
  SELECT b.line FROM t a JOIN t b ON a.token = b.token AND a.line <> b.line
  GROUP BY a.line, b.line, a.n, b.n
  HAVING 100 * COUNT(*) >= 75 * (a.n + b.n - COUNT(*))
    AND (SELECT first FROM f WHERE f.line = a.line) < (SELECT first FROM f WHERE f.line = b.line)),
k AS (
  SELECT l.doc_id, l.pos, l.line,
    l.line IN (SELECT line FROM w) AND (struct_pack(d := l.doc_id, a := l.pos) <> f.first OR l.line IN (SELECT line FROM m)) AS gone
  FROM l JOIN f ON l.line = f.line)
SELECT doc_id, COALESCE(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text, SUM(gone::INT)::BIGINT AS removed_lines
FROM k GROUP BY doc_id
"""


@query("op5_line_dedup", OP5_SQL)
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"), percent=75)
    return out.select("doc_id", "text", "removed_lines")


@query("op6_context_mixing")
def op6_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_texts(docs, id_crc() % 10 == 0, file_block(5000, 1 << 22))


@query("op7_syncmers")
def op7_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compare_with_edits(table(spark, sf_dir, "documents"))
    prints = (fingerprint_text(F.col(c)).alias(n) for c, n in (("places", "fingerprint"), ("edited_places", "edited_fingerprint")))
    return out.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), *prints, "near_edited", "near_next")


@query("op8_prefix_forest")
def op8_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' ')) END) AS tokens FROM w),
t AS (SELECT doc_id, len(tokens) AS n, unnest(tokens) AS token FROM s),
e AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM t a JOIN t b ON a.token = b.token AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * COUNT(*) >= 75 * (a.n + b.n - COUNT(*))),
r(x, y) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT s.doc_id, CAST(len(s.tokens) AS BIGINT) AS n_shingles, (SELECT MIN(y) FROM r WHERE r.x = s.doc_id) AS component_id FROM s
"""


@query("op9_shingle_join", OP9_SQL)
def op9_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), percent=75)


@query("op10_token_files")
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_token_files(spark, manifest)


OP11_SQL = """
WITH t AS (
  SELECT conv_id, COALESCE(role, '') AS r, COALESCE(text, '') AS t, turn FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(struct_pack(r := r, t := t) ORDER BY turn NULLS FIRST, r, t) AS turns FROM t GROUP BY conv_id),
-- CRC-32 of the decimal id, bit by bit.
h AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), list_transform(range(8), lambda i: 0::BIGINT)),
      lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)), 4294967295) % 9 AS h FROM own),
b AS (
  SELECT h.conv_id, list_concat(COALESCE(o.turns[1:h.h], []), h.turns[h.h + 1:]) AS turns
  FROM h LEFT JOIN own o ON o.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, turns[1:d] AS node, d, len(turns) = d AS last FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM b)),
n AS (
  SELECT node, d, MIN(conv_id) AS conv_id, COUNT(*) AS n, sha256(COALESCE(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends
  FROM p GROUP BY node, d),
k AS (SELECT node[1:d - 1] AS node, COUNT(*) AS children FROM n WHERE d > 0 GROUP BY 1),
w AS (
  SELECT n.*, COALESCE(k.children, 0) AS children, CASE WHEN d = 0 THEN 0 ELSE (n - 1) * strlen(n.node[-1].t) END AS saved
  FROM n LEFT JOIN k ON n.node = k.node),
s AS (
  SELECT a.node, SUM(b.saved) AS saved, COUNT(*) FILTER (b.children = 0) AS leaves FROM w a JOIN w b ON b.d >= a.d AND b.node[1:a.d] = a.node
  GROUP BY a.node)
SELECT w.conv_id, CAST(w.d AS BIGINT) AS depth, CAST(up.conv_id AS DOUBLE) AS parent_conv_id, w.n AS n_convs, CAST(w.children AS BIGINT) AS n_children,
  CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, w.ends AS ends_sha256
FROM w JOIN s ON w.node = s.node LEFT JOIN n up ON w.d > 0 AND up.d = w.d - 1 AND up.node = w.node[1:w.d - 1]
"""


@query("op11_prefix_trie", OP11_SQL)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


OP12_SQL = r"""
WITH w AS (
  SELECT doc_id, COALESCE(lang, '') AS part, COALESCE(text, '') AS t,
    list_filter(string_split_regex(COALESCE(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
l AS (SELECT doc_id, MAX((quality = 1)::INT) AS good, MAX((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
      100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'),
      COALESCE(w.doc_id > MIN(w.doc_id) OVER (PARTITION BY t), FALSE)] AS fails,
    COALESCE(good, 0) AS good, COALESCE(toxic, 0) AS toxic
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, fails, COUNT(*) AS n, SUM(good) AS good, SUM(toxic) AS toxic FROM f GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (
  SELECT a.c || b.c || d.c || e.c || g.c AS filter_order FROM x a, x b, x d, x e, x g
  WHERE len(list_distinct([a.c, b.c, d.c, e.c, g.c])) = 5),
r AS (
  SELECT *, list_min(list_transform(range(1, 6), lambda i: CASE WHEN fails[i] THEN strpos(filter_order, substr('ABCDE', i, 1)) ELSE 6 END)) AS gone
  FROM c, o),
s AS (SELECT *, unnest(range(1, 6)) AS step FROM r),
h AS (SELECT *, fails[strpos('ABCDE', substr(filter_order, step, 1))] AS here, len(list_filter(fails, lambda v: v)) AS failed FROM s),
a AS (
  SELECT part, filter_order, CAST(step AS INT) AS step,
    COALESCE(SUM(n) FILTER (gone > step), 0)::BIGINT AS kept, COALESCE(SUM(n) FILTER (gone = step), 0)::BIGINT AS removed,
    COALESCE(SUM(n) FILTER (here AND gone < step), 0)::BIGINT AS redundant, COALESCE(SUM(n) FILTER (here AND failed = 1), 0)::BIGINT AS unique_fails,
    COALESCE(SUM(good) FILTER (gone = step), 0)::BIGINT AS good_lost, COALESCE(SUM(toxic) FILTER (gone = step), 0)::BIGINT AS toxic_lost
  FROM h GROUP BY part, filter_order, step)
SELECT *, CAST(SUM(removed) OVER (PARTITION BY part, substr(filter_order, step, 1)) AS BIGINT) AS shapley FROM a
"""


@query("op12_filter_audit", OP12_SQL)
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = """
WITH d AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(COALESCE(text, ''))) AS x FROM documents),
w AS (SELECT k, doc_id, s, substr(x, 2 * s + 1, 100) AS g FROM (SELECT *, unnest(range(len(x) // 2 - 49)) AS s FROM d)),
f AS (SELECT g, MIN(doc_id) AS least FROM w GROUP BY g),
h AS (SELECT w.k, w.s, w.s - lag(w.s) OVER (PARTITION BY w.k ORDER BY w.s) AS gap FROM w JOIN f ON w.g = f.g WHERE f.least < w.doc_id),
r AS (SELECT *, SUM(CASE WHEN gap <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY s) AS run FROM h),
p AS (SELECT k, run, MIN(s) AS a, MAX(s) + 50 AS b FROM r GROUP BY k, run),
q AS (
  SELECT d.k, p.a, p.b, substr(x, 2 * COALESCE(lag(p.b) OVER (PARTITION BY p.k ORDER BY p.a), 0) + 1, 2 * (p.a - COALESCE(lag(p.b) OVER (PARTITION BY p.k ORDER BY p.a), 0))) AS piece
  FROM p JOIN d ON p.k = d.k),
t AS (SELECT k, COUNT(*) AS n, SUM(b - a) AS gone, MAX(b) AS last, string_agg(piece, '' ORDER BY a) AS front FROM q GROUP BY k)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(COALESCE(gone, 0) AS BIGINT) AS n_removed, CAST(COALESCE(n, 0) AS BIGINT) AS n_spans,
  sha256(unhex(COALESCE(front, '') || substr(x, 2 * COALESCE(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN t ON d.k = t.k
"""


@query("op13_suffix_dedup", OP13_SQL)
def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cut_repeats(table(spark, sf_dir, "documents"), file_block(512, 1 << 40))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
