"""Naming and skill standardisation.

The reference asks a hosted model for names and canonical skills; here the
same records come from rules over the aggregated tables: a name from the
representative titles (its documented fallback), a slug id, and canonical
spellings from normalised text.  A user-supplied mapping table (original,
standardized) is applied with an equi-join that AQE broadcasts only when its
measured size is under the broadcast threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import fallback_name, freq_label, slugify, word_split


def apply_mapping(items: DataFrame, mapping: DataFrame, item_col: str = "item") -> DataFrame:
    """Replace an item by its standard name; unmapped items keep their own."""
    m = mapping.select(F.col("original").alias("_orig"), F.col("standardized").alias("_std"))
    j = items.join(m, items[item_col] == m["_orig"], "left")
    return j.withColumn(item_col, F.coalesce(F.col("_std"), F.col(item_col))).drop("_orig", "_std")


def standardize_frequencies(freq: DataFrame, mapping: DataFrame) -> DataFrame:
    """Frequencies re-keyed by standard name; on a clash the larger frequency is kept."""
    mapped = apply_mapping(freq, mapping)
    return mapped.groupBy("cluster", "category", "kind", "item").agg(F.max("freq").alias("freq"))


def mapping_groups(mapping: DataFrame) -> DataFrame:
    """Standard names with more than one original, originals sorted."""
    g = mapping.groupBy("standardized").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_originals"),
        F.array_join(F.array_sort(F.collect_list("original")), ", ").alias("originals"),
    )
    return g.where(F.col("n_originals") > 1)


def mapping_counts(mapping: DataFrame) -> DataFrame:
    """Changed and unchanged mapping counts."""
    changed = F.col("original") != F.col("standardized")
    return mapping.agg(F.count_if(changed).cast("bigint").alias("changed"), F.count_if(~changed).cast("bigint").alias("unchanged"))


def normalize_item(c) -> Column:
    """R06 rule: lower case, trimmed, inner blanks collapsed."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(F.lower(c), "(?U)\\s+", " "))


def standardize_items(items: DataFrame, item_col: str = "item") -> DataFrame:
    """Mapping (original, standardized): every spelling of a normalised
    form maps to its most frequent spelling (ties: smallest)."""
    c = items.groupBy(item_col).agg(F.count(F.lit(1)).alias("n")).withColumn("_key", normalize_item(item_col))
    w = Window.partitionBy("_key").orderBy(F.desc("n"), F.asc(item_col))
    best = c.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("_key", F.col(item_col).alias("_best"))
    return c.join(best, "_key").select(F.col(item_col).alias("original"), F.col("_best").alias("standardized"))


def compare_archetypes(merged: DataFrame, a: int, b: int) -> DataFrame:
    """Two archetypes' skill maps side by side, absent = 0, unique flags."""
    x = merged.where(F.col("cluster") == a).select("item", F.col("freq").alias("fa"))
    y = merged.where(F.col("cluster") == b).select("item", F.col("freq").alias("fb"))
    j = x.join(y, "item", "full_outer")
    return j.select(
        "item",
        F.coalesce("fa", F.lit(0.0)).alias("freq_a"),
        F.coalesce("fb", F.lit(0.0)).alias("freq_b"),
        (F.coalesce("fa", F.lit(0.0)) - F.coalesce("fb", F.lit(0.0))).alias("diff"),
        F.col("fa").isNull().alias("only_b"),
        F.col("fb").isNull().alias("only_a"),
    )


def id_overlap(a: DataFrame, b: DataFrame, id_field: str = "jd_id") -> DataFrame:
    """Ids in A, in B and in both (full outer join of the distinct ids)."""
    x = a.select(F.col(id_field).alias("_a")).distinct()
    y = b.select(F.col(id_field).alias("_b")).distinct()
    j = x.join(y, x["_a"] == y["_b"], "full_outer")
    return j.agg(
        F.count("_a").cast("bigint").alias("in_a"),
        F.count("_b").cast("bigint").alias("in_b"),
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).cast("bigint").alias("in_both"),
    )


def name_archetypes(titles: DataFrame) -> DataFrame:
    """R07 + T13 + T07: name from the top titles, slug id made unique per run.

    ``titles`` is (cluster, rank, title).  Clusters with the same slug get
    suffixes -2, -3 ... in cluster order.
    """
    t = titles.groupBy("cluster").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "title"))), lambda x: x["title"]).alias("titles")
    )
    named = t.select("cluster", fallback_name(F.col("titles"), F.col("cluster")).alias("archetype_name"))
    named = named.withColumn("_slug", slugify("archetype_name"))
    w = Window.partitionBy("_slug").orderBy("cluster")
    r = F.row_number().over(w)
    return named.select(
        "cluster",
        "archetype_name",
        F.when(r == 1, F.col("_slug")).otherwise(F.concat(F.col("_slug"), F.lit("-"), r.cast("string"))).alias("archetype_id"),
    )


def word_frequency(labels: DataFrame, label_col: str = "archetype_name", top: int = 20) -> DataFrame:
    """Most common words in labels."""
    w = labels.select(F.explode(word_split(label_col)).alias("word")).where(F.length("word") > 0)
    return w.groupBy("word").agg(F.count(F.lit(1)).cast("bigint").alias("count")).orderBy(F.desc("count"), "word").limit(top)


def naming_features(freq: DataFrame, titles: DataFrame, dist: DataFrame) -> DataFrame:
    """Per archetype the inputs for a name: titles, top division and function,
    top 5 skills (technical + domain), licences + certificates, tools."""
    from scriptorium.operators.archetypes import merged_skill_freq, rank_within

    def label_of(categories, name):
        m = merged_skill_freq(freq, categories, "last")
        r = rank_within(m, ["cluster"], [F.desc("freq"), F.asc("item")], 5)
        return r.groupBy("cluster").agg(
            freq_label(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item", "freq"))), lambda x: F.struct(x["item"].alias("item"), x["freq"].alias("freq"))), 5).alias(name)
        )

    t = titles.where(F.col("rank") <= 5).groupBy("cluster").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "title"))), lambda x: F.concat(F.lit("- "), x["title"])), "\n").alias("titles")
    )
    top = dist.where(F.col("rank") == 1).groupBy("cluster").pivot("field", ["division", "function"]).agg(F.first("value"))
    out = t.join(top, "cluster", "full_outer")
    for cats, name in [(["technical", "domain"], "top_skills"), (["licenses", "certifications"], "top_licenses"), (["tools"], "top_tools")]:
        out = out.join(label_of(cats, name), "cluster", "full_outer")
    return out.select(
        "cluster",
        F.coalesce(F.nullif("titles", F.lit("")), F.lit("(none)")).alias("titles"),
        F.coalesce("division", F.lit("(none)")).alias("top_division"),
        F.coalesce("function", F.lit("(none)")).alias("top_function"),
        F.coalesce("top_skills", F.lit("(none)")).alias("top_skills"),
        F.coalesce("top_licenses", F.lit("(none)")).alias("top_licenses"),
        F.coalesce("top_tools", F.lit("(none)")).alias("top_tools"),
    )
