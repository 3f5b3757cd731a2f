"""Cluster evaluation and archetype aggregation.

Inputs are long tables keyed by the string id:
  assignments (jd_id, cluster)             one row per record
  metadata    (jd_id, title, division, function, level, years_min, years_preferred)
  items       (jd_id, pos, category, kind, item)   requirement items
A record "has an extraction" when it has at least one item row.

Scale notes: every frequency is a grouped count with map-side partial
aggregation, so a cluster holding a third of all records is pre-aggregated on
every partition before its keys are shuffled.  Per-cluster top-k lists rank
the aggregated (cluster, value) rows with a literal limit, which Spark plans
as a partial WindowGroupLimit before the exchange.  Per-cluster tables (one
row per cluster) join back without a shuffle of the large side when AQE sees
they are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.numeric import rnd

# --- fixed values ----------------------------------------------------------
SKILL_CATEGORIES = ["technical", "domain", "soft"]
KINDS = ["required", "preferred"]
DOMINANT_SHARE_PCT = 40
TOP_VALUES = 5
TOP_TITLES = 5
TOP_SKILLS = 5
# ---------------------------------------------------------------------------


def _n():
    return F.count(F.lit(1))


def rank_within(df: DataFrame, parts, order, limit: int | None = None, name: str = "rank") -> DataFrame:
    w = Window.partitionBy(*parts).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w))
    return out.where(F.col(name) <= limit) if limit else out


def exclude_noise(df: DataFrame) -> DataFrame:
    """F06."""
    return df.where(F.col("cluster") != -1)


def with_extraction(assign: DataFrame, items: DataFrame) -> DataFrame:
    """Members that have at least one item (semi join; no item rows multiply)."""
    return assign.join(items.select("jd_id"), "jd_id", "left_semi")


# ---------------------------------------------------------------- cluster evaluation

def cluster_sizes(assign: DataFrame) -> DataFrame:
    """Rows per cluster, noise included."""
    return assign.groupBy("cluster").agg(_n().cast("bigint").alias("size"))


def cluster_summary(assign: DataFrame) -> DataFrame:
    """Number of clusters (noise excluded), noise count and ratio."""
    noise = F.col("cluster") == -1
    return assign.agg(
        F.count_distinct(F.when(~noise, F.col("cluster"))).cast("bigint").alias("n_clusters"),
        F.count_if(noise).cast("bigint").alias("n_noise"),
        rnd(F.try_divide(F.count_if(noise), _n()), 4).alias("noise_ratio"),
    )


def cluster_composition(df: DataFrame, fields, top: int = TOP_VALUES) -> DataFrame:
    """Per cluster and field - top values, dominant value (> 40 %), its %, distinct count."""
    total = df.select(_n()).scalar()
    sizes = df.groupBy("cluster").agg(_n().alias("size"))
    long = df.select("cluster", *[F.col(f).cast("string").alias(f) for f in fields]).unpivot(["cluster"], list(fields), "field", "value")
    counts = long.where(F.col("value").isNotNull()).groupBy("cluster", "field", "value").agg(_n().alias("count"))
    ranked = rank_within(counts, ["cluster", "field"], [F.desc("count"), F.asc("value")])
    per = ranked.groupBy("cluster", "field").agg(
        F.count(F.lit(1)).cast("bigint").alias("unique_values"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.when(F.col("rank") <= top, F.struct("rank", "value", "count")))),
                lambda x: F.concat(x["value"], F.lit(":"), x["count"].cast("string")),
            ),
            ", ",
        ).alias("top_values"),
        F.max_by(F.struct("value", "count"), -F.col("rank")).alias("_top"),
    )
    j = per.join(sizes, "cluster")
    pct = F.col("_top.count") * 100.0 / F.col("size")
    return j.select(
        "cluster",
        "field",
        "top_values",
        F.when(pct > DOMINANT_SHARE_PCT, F.col("_top.value")).alias("dominant"),
        rnd(pct, 1).alias("dominant_pct"),
        "unique_values",
        F.col("size").cast("bigint").alias("size"),
        rnd(F.col("size") * 100.0 / total, 2).alias("percentage"),
    )


def _mode_counts(df: DataFrame, label: str) -> DataFrame:
    counts = df.where(F.col(label).isNotNull()).groupBy("cluster", label).agg(_n().alias("mode_count"))
    return rank_within(counts, ["cluster"], [F.desc("mode_count"), F.asc(label)], 1).drop("rank")


def cluster_purity(df: DataFrame, label: str, drop_noise: bool = False) -> DataFrame:
    """Per cluster the most common label (ties: smallest), its share (3 dp), size."""
    d = exclude_noise(df) if drop_noise else df
    sizes = d.groupBy("cluster").agg(_n().alias("size"))
    m = _mode_counts(d, label).join(sizes, "cluster")
    return m.select(
        "cluster",
        F.col(label).cast("string").alias("dominant_label"),
        rnd(F.col("mode_count") / F.col("size"), 3).alias("purity"),
        F.col("size").cast("bigint").alias("size"),
        F.col("mode_count").cast("bigint").alias("mode_count"),
    )


def overall_purity(df: DataFrame, label: str, drop_noise: bool = False) -> DataFrame:
    """overall = sum of mode counts / rows; mean of the per-cluster (rounded) purities."""
    p = cluster_purity(df, label, drop_noise)
    return p.agg(
        rnd(F.sum("mode_count") / F.sum("size"), 3).alias("overall_purity"),
        F.avg("purity").alias("mean_purity"),
        _n().cast("bigint").alias("n_clusters"),
    )


def purity_rollup(df: DataFrame, label: str) -> DataFrame:
    """Size-weighted and plain mean purity, mean distinct labels per cluster."""
    p = cluster_purity(df, label, drop_noise=True)
    distinct = exclude_noise(df).groupBy("cluster").agg(F.count_distinct(label).alias("n_labels"))
    j = p.join(distinct, "cluster")
    return j.agg(
        (F.sum(F.col("purity") * F.col("size")) / F.sum("size")).alias("weighted_purity"),
        F.avg("purity").alias("mean_purity"),
        F.avg("n_labels").alias("mean_distinct_labels"),
        F.max("n_labels").cast("bigint").alias("max_distinct_labels"),
    )


def purity_histogram(df: DataFrame, label: str, bins: int = 20) -> DataFrame:
    """Histogram of cluster purities over [0, 1]."""
    p = cluster_purity(df, label, drop_noise=True)
    return p.groupBy(F.width_bucket("purity", F.lit(0.0), F.lit(1.0), F.lit(bins)).alias("bucket")).agg(
        _n().cast("bigint").alias("clusters")
    )


def crosstab_share(df: DataFrame, label: str) -> DataFrame:
    """Cluster x label share, each cluster's shares sum to 1 (long form)."""
    c = df.groupBy("cluster", label).agg(_n().alias("c"))
    return c.select(
        "cluster", F.col(label).cast("string").alias("label"), (F.col("c") / F.sum("c").over(Window.partitionBy("cluster"))).alias("share")
    )


def noise_profile(df: DataFrame, label: str, top: int = 20) -> DataFrame:
    """Label counts among noise points."""
    c = df.where(F.col("cluster") == -1).groupBy(label).agg(_n().cast("bigint").alias("count"))
    return c.orderBy(F.desc("count"), F.asc(label)).limit(top)


def size_stats(assign: DataFrame) -> DataFrame:
    """min/max/mean/median/population std of cluster sizes (noise excluded)."""
    s = cluster_sizes(exclude_noise(assign))
    return s.agg(
        F.min("size").cast("bigint").alias("min_size"),
        F.max("size").cast("bigint").alias("max_size"),
        F.avg("size").alias("mean_size"),
        F.median("size").alias("median_size"),
        F.stddev_pop("size").alias("std_size"),
    )


# ---------------------------------------------------------------- archetype parts

def member_counts(assign: DataFrame, items: DataFrame) -> DataFrame:
    """Per cluster, members with an extraction and all members."""
    ext = with_extraction(assign, items).groupBy("cluster").agg(_n().cast("bigint").alias("member_count"))
    allm = assign.groupBy("cluster").agg(_n().cast("bigint").alias("member_total"))
    return allm.join(ext, "cluster", "left").select("cluster", F.coalesce("member_count", F.lit(0)).alias("member_count"), "member_total")


def item_frequency(assign: DataFrame, items: DataFrame, distinct_per_doc: bool = False) -> DataFrame:
    """Item count / members with extraction, per (cluster, category, kind, item), ranked.

    A repeated item in one record counts twice (values may exceed 1) unless
    ``distinct_per_doc``.
    """
    it = items.select("jd_id", "category", "kind", "item")
    if distinct_per_doc:
        it = it.distinct()
    members = member_counts(assign, items).select("cluster", "member_count")
    counts = assign.select("jd_id", "cluster").join(it, "jd_id").groupBy("cluster", "category", "kind", "item").agg(_n().alias("count"))
    f = counts.join(members, "cluster").select(
        "cluster", "category", "kind", "item", F.col("count").cast("bigint").alias("count"), (F.col("count") / F.col("member_count")).alias("freq")
    )
    return rank_within(f, ["cluster", "category", "kind"], [F.desc("count"), F.asc("item")])


def field_distribution(assign: DataFrame, meta: DataFrame, items: DataFrame, fields=("level", "division", "function")) -> DataFrame:
    """Per cluster the share of each value; empty values leave the numerator only."""
    ext = with_extraction(assign, items).join(meta.drop("cluster") if "cluster" in meta.columns else meta, "jd_id")
    members = member_counts(assign, items).select("cluster", "member_count")
    long = ext.select("cluster", *[F.col(f).cast("string").alias(f) for f in fields]).unpivot(["cluster"], list(fields), "field", "value")
    c = long.where(F.col("value").isNotNull() & (F.col("value") != "")).groupBy("cluster", "field", "value").agg(_n().alias("count"))
    d = c.join(members, "cluster").select("cluster", "field", "value", F.col("count").cast("bigint").alias("count"), (F.col("count") / F.col("member_count")).alias("share"))
    return rank_within(d, ["cluster", "field"], [F.desc("count"), F.asc("value")])


def representative_titles(assign: DataFrame, meta: DataFrame, items: DataFrame, n: int = TOP_TITLES) -> DataFrame:
    """The n most common titles of members with an extraction."""
    ext = with_extraction(assign, items).join(meta.select("jd_id", "title"), "jd_id")
    c = ext.where(F.col("title").isNotNull() & (F.col("title") != "")).groupBy("cluster", "title").agg(_n().alias("count"))
    return rank_within(c, ["cluster"], [F.desc("count"), F.asc("title")], n).select("cluster", "rank", "title", F.col("count").cast("bigint"))


def years_stats(assign: DataFrame, meta: DataFrame, items: DataFrame) -> DataFrame:
    """Medians of years (NULLs skipped) and the range [min(min) or 0, max(pref, else min, else 0)]."""
    ext = with_extraction(assign, items).join(meta.select("jd_id", "years_min", "years_preferred"), "jd_id")
    return ext.groupBy("cluster").agg(
        F.median("years_min").alias("years_min_median"),
        F.median("years_preferred").alias("years_preferred_median"),
        F.coalesce(F.min("years_min"), F.lit(0)).cast("bigint").alias("range_low"),
        F.coalesce(F.max("years_preferred"), F.max("years_min"), F.lit(0)).cast("bigint").alias("range_high"),
    )


def centroids(vectors: DataFrame, assign: DataFrame, features: str = "features") -> DataFrame:
    """Mean vector per cluster, one row per (cluster, dim).

    posexplode + avg keeps the work in partial aggregates; no vector list is
    gathered per cluster.
    """
    j = vectors.select("jd_id", features).join(assign, "jd_id")
    e = j.select("cluster", F.posexplode(features).alias("dim", "x"))
    return e.groupBy("cluster", "dim").agg(F.avg(F.col("x").cast("double")).alias("value")).select(
        "cluster", F.col("dim").cast("bigint").alias("dim"), "value"
    )


def centroid_arrays(centroid_long: DataFrame) -> DataFrame:
    """Centroids as (cluster, array<double>) in dimension order (one small row per cluster)."""
    return centroid_long.groupBy("cluster").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda x: x["value"]).alias("centroid")
    )


def merged_skill_freq(freq: DataFrame, categories=SKILL_CATEGORIES, rule: str = "last") -> DataFrame:
    """Merge the per-(category, kind) maps of the skill categories into one per cluster.

    ``rule='last'`` reproduces dict.update order (technical required, technical
    preferred, domain ..., soft ...; a later map wins); ``rule='max'`` keeps the
    largest frequency.
    """
    f = freq.where(F.col("category").isin(list(categories)))
    prio = F.lit(0)
    for i, c in enumerate(categories):
        prio = F.when(F.col("category") == c, F.lit(i * 2)).otherwise(prio)
    prio = prio + F.when(F.col("kind") == "preferred", 1).otherwise(0)
    f = f.withColumn("_prio", prio)
    val = F.max_by("freq", "_prio") if rule == "last" else F.max("freq")
    return f.groupBy("cluster", "item").agg(val.alias("freq"))


def top_skills(freq: DataFrame, n: int = TOP_SKILLS, categories=SKILL_CATEGORIES) -> DataFrame:
    """Top n skills per archetype from the merged map (ties by item)."""
    m = merged_skill_freq(freq, categories, "last")
    return rank_within(m, ["cluster"], [F.desc("freq"), F.asc("item")], n)


def top_value(dist: DataFrame, field: str) -> DataFrame:
    """The top entry of a ranked distribution (max_by with the tie-break, not map order)."""
    return dist.where((F.col("field") == field) & (F.col("rank") == 1)).select("cluster", F.col("value").alias(f"top_{field}"))


def archetype_summary(assign: DataFrame, meta: DataFrame, items: DataFrame) -> DataFrame:
    """Cluster, members, 3 titles, 5 top skills, top division (noise excluded)."""
    a = exclude_noise(assign)
    members = member_counts(a, items).where(F.col("member_count") > 0)
    titles = representative_titles(a, meta, items).where(F.col("rank") <= 3).groupBy("cluster").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "title"))), lambda x: x["title"]), "; ").alias("representative_titles")
    )
    skills = top_skills(item_frequency(a, items)).groupBy("cluster").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda x: x["item"]), "; ").alias("top_skills")
    )
    div = top_value(field_distribution(a, meta, items, ("division",)), "division")
    return (
        members.join(titles, "cluster", "left")
        .join(skills, "cluster", "left")
        .join(div, "cluster", "left")
        .select(
            F.col("cluster").alias("cluster_id"),
            "member_count",
            F.coalesce("representative_titles", F.lit("")).alias("representative_titles"),
            F.coalesce("top_skills", F.lit("")).alias("top_skills"),
            F.coalesce("top_division", F.lit("")).alias("top_division"),
        )
    )


def _ranked_struct_list(df: DataFrame, key: str, fields) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col("rank"), *[F.col(f) for f in fields]))), lambda x: F.struct(*[x[f] for f in fields]))


def archetype_records(assign: DataFrame, meta: DataFrame, items: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """One nested record per cluster (noise excluded).

    Frequencies are arrays of struct<item, freq, rank> per (category, kind)
    (bounded by the item vocabulary), distributions arrays of struct<value,
    share> (bounded by the field's values).  member_total counts every member,
    member_count only those with an extraction; the member ids themselves stay
    a long table (``archetype_members``) - a cluster can hold a third of all
    records, so its ids are never gathered into one row.
    """
    a = exclude_noise(assign)
    mc = member_counts(a, items).where(F.col("member_count") > 0)
    freq = item_frequency(a, items)
    fmaps = freq.groupBy("cluster").pivot("category").agg(
        *[
            F.transform(
                F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("rank", "item", "freq")))),
                lambda x: F.struct(x["item"].alias("item"), x["freq"].alias("freq"), x["rank"].alias("rank")),
            ).alias(k)
            for k in KINDS
        ]
    )
    dist = field_distribution(a, meta, items)
    dists = dist.groupBy("cluster").pivot("field", ["level", "division", "function"]).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "value", "share"))), lambda x: F.struct(x["value"].alias("value"), x["share"].alias("share"))).alias("distribution")
    )
    titles = representative_titles(a, meta, items).groupBy("cluster").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "title"))), lambda x: x["title"]).alias("representative_titles")
    )
    years = years_stats(a, meta, items)
    out = mc.join(titles, "cluster", "left").join(dists, "cluster", "left").join(fmaps, "cluster", "left").join(years, "cluster", "left")
    if vectors is not None:
        out = out.join(centroid_arrays(centroids(vectors, a)), "cluster", "left")
    return out.withColumn("created_at", F.current_timestamp())


def archetype_members(assign: DataFrame) -> DataFrame:
    """A37 member_ids as a long table (cluster, jd_id), noise excluded."""
    return exclude_noise(assign).select("cluster", "jd_id")


def skill_totals(assign: DataFrame, items: DataFrame, top: int = 30) -> DataFrame:
    """Sum over archetypes of freq x members, top 30 skills."""
    a = exclude_noise(assign)
    m = merged_skill_freq(item_frequency(a, items)).join(member_counts(a, items), "cluster")
    t = m.groupBy("item").agg(F.sum(F.col("freq") * F.col("member_count")).alias("total"))
    return t.orderBy(F.desc("total"), F.asc("item")).limit(top)


def skill_matrix(assign: DataFrame, items: DataFrame, top: int = 30) -> DataFrame:
    """Archetype x top skills, max over kinds, 0 where absent (long form).

    The top list is at most ``top`` values (a proven bound), so the pivot
    columns are known; zero filling happens in the pivot, with no cross join.
    """
    a = exclude_noise(assign)
    skills = [r["item"] for r in skill_totals(assign, items, top).select("item").collect()]
    m = merged_skill_freq(item_frequency(a, items), rule="max").where(F.col("item").isin(skills))
    wide = m.groupBy("cluster").pivot("item", skills).agg(F.max("freq")).fillna(0.0)
    clusters = member_counts(a, items).where(F.col("member_count") > 0).select("cluster")
    wide = clusters.join(wide, "cluster", "left").fillna(0.0)
    if not skills:
        return wide.select("cluster", F.lit(None).cast("string").alias("item"), F.lit(0.0).alias("value")).where(F.lit(False))
    return wide.unpivot(["cluster"], [F.col(f"`{s}`").alias(s) for s in skills], "item", "value")


def grid_zero_fill(df: DataFrame, row_key: str, col_key: str, max_columns: int = 1000) -> DataFrame:
    """row_key x col_key counts with 0 for absent pairs (pivot, bounded columns)."""
    values = [r[0] for r in df.select(col_key).distinct().limit(max_columns + 1).collect()]
    if len(values) > max_columns:
        raise ValueError(f"{col_key} has more than {max_columns} values; the grid would not be bounded")
    values = sorted(v for v in values if v is not None)
    wide = df.groupBy(row_key).pivot(col_key, values).agg(_n()).fillna(0)
    return wide.unpivot([row_key], [F.col(f"`{v}`").alias(str(v)) for v in values], col_key, "count").select(
        row_key, col_key, F.col("count").cast("bigint")
    )


def cluster_examples(df: DataFrame, n: int = 3, seed: int = 42, text_field: str = "jd_text", title_field: str = "title") -> DataFrame:
    """N seeded example rows per cluster with a 500-character preview."""
    from scriptorium.functions.text import preview
    from scriptorium.operators.sampling import hash_order

    w = Window.partitionBy("cluster").orderBy(hash_order("jd_id", seed), F.col("jd_id"))
    ex = df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return ex.select("cluster", "rank", "jd_id", F.col(title_field).alias("title"), preview(text_field, 500, True).alias("text_preview"))


def cluster_skill_sample(assign: DataFrame, items: DataFrame, n_clusters: int = 5, n_skills: int = 10) -> DataFrame:
    """The largest clusters and their top skills (technical + domain + soft, item counts)."""
    a = exclude_noise(assign)
    sizes = cluster_sizes(a)
    top = sizes.orderBy(F.desc("size"), F.asc("cluster")).limit(n_clusters)
    it = items.where(F.col("category").isin(SKILL_CATEGORIES))
    c = a.join(top.select("cluster"), "cluster", "left_semi").join(it, "jd_id").groupBy("cluster", "item").agg(_n().cast("bigint").alias("count"))
    return rank_within(c, ["cluster"], [F.desc("count"), F.asc("item")], n_skills)
