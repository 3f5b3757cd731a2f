"""Training-data pipeline over ``documents``: quality, repeated lines, near copies, mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
every stage's result to the shared folder and reads it again for the next one.

Every row has a key of its own, ``_row``, in the order of doc_id (null first);
stages join and reject by it, so rows with a null or repeated doc_id are rows
like others.  The first stage writes it, and results up to the mix carry it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.bpe import encode_documents
from scriptorium.llm.common import staged, without
from scriptorium.llm.line_dedup import dedup_lines
from scriptorium.llm.mixing import mix
from scriptorium.llm.queries import id_crc
from scriptorium.llm.ranking import score_quality
from scriptorium.llm.shingle_join import jaccard_components
from scriptorium.sources.tables import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ROW = "_row"


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a row key, written once where it is new."""
    if ROW in docs.columns:
        return docs.select(ROW, *COLUMNS)
    # Rows of one id may lie in several ranges, told apart by any number.
    spread = docs.select(*COLUMNS, F.xxhash64("text", F.monotonically_increasing_id()).alias("_any"))
    ranged = spread.repartitionByRange("doc_id", "_any").sortWithinPartitions("doc_id", "_any")
    return staged(ranged.select(F.monotonically_increasing_id().alias(ROW), *COLUMNS), "pipeline-rows", "zstd")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    docs = keyed(docs)
    scored = score_quality(docs, table(spark, sf_dir, "labels"), id_crc() % 5 == 0, row_col=ROW)
    bad = scored.filter("predicted = 0").select(ROW)
    return without(docs, bad, ROW, "pipeline-bad").select(ROW, *COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier line matches; documents left without words go."""
    kept = dedup_lines(keyed(docs), id_col=ROW).withColumn("n_chars", F.length("text").cast("long"))
    return kept.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]") | (F.col("removed_lines") == 0)).select(ROW, *COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row (of the smallest id) of each group of near copies."""
    docs = keyed(docs)
    nodes = jaccard_components(docs, id_col=ROW)
    copies = nodes.filter("component_id < doc_id").select(F.col("doc_id").alias(ROW))
    return without(docs, copies, ROW, "pipeline-copies").select(ROW, *COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    docs = keyed(docs)
    taken = mix(docs, row_col=ROW).filter("repeats > 0").select(ROW, "repeats")
    often = docs.join(taken, ROW)
    return often.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats")))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix."""
    out = encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("mix", mixed), ("tokens", tokens)]
# The classifier and the tokenizer are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
