"""Stratified and seeded sampling.

Randomness is a hash order: ``md5(id || seed)`` ranks the rows, so a sample is
deterministic, identical in any engine with md5, and needs no shuffle of the
whole table.  Per-stratum top-k uses ``row_number() <= n`` with a literal n,
which Spark turns into a map-side WindowGroupLimit: even a stratum holding a
third of all rows sends at most n rows per input partition to its final rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.numeric import rnd

SEED = 42


def hash_order(id_col: str, seed: int = SEED) -> Column:
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(str(seed))))


def strata_distribution(df: DataFrame, org_field: str = "org_unit", level_field: str = "level") -> DataFrame:
    """Count and % (2 dp) per (org, level), NULL keys dropped."""
    g = (
        df.where(F.col(org_field).isNotNull() & F.col(level_field).isNotNull())
        .groupBy(org_field, level_field)
        .agg(F.count(F.lit(1)).cast("bigint").alias("count"))
    )
    total = g.select(F.sum("count")).scalar()
    return g.withColumn("percentage", rnd(F.col("count") * 100.0 / total, 2))


def _ranked_within(df: DataFrame, keys, id_field: str, seed: int, cap: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(hash_order(id_field, seed), F.col(id_field))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= cap)


def sample_stratified(
    df: DataFrame,
    n: int = 100,
    min_per_stratum: int = 1,
    seed: int = SEED,
    org_field: str = "org_unit",
    level_field: str = "level",
    id_field: str = "jd_id",
) -> DataFrame:
    """Three-pass stratified sample of exactly min(n, rows) rows.

    Pass 1 gives each stratum (in key order) min(min_per_stratum, size) rows
    until n is used up; pass 2 adds floor(size/total * remaining) rows capped
    by what is left in the stratum; pass 3 tops up from all unsampled rows
    (NULL strata included) in global hash order.  Passes 1 and 2 take a
    stratum's rows in its hash order, so the union of both passes is a prefix
    of that order (exact exclusion). Output adds ``sample_pass`` (1, 2 or 3).
    """
    keyed = df.where(F.col(org_field).isNotNull() & F.col(level_field).isNotNull())
    total = df.select(F.count(F.lit(1))).scalar()
    strata = keyed.groupBy(org_field, level_field).agg(F.count(F.lit(1)).alias("size"))
    # Strata are ordered by key for pass 1; the window runs over the (small)
    # strata table, one row per stratum, not over the records.
    kw = Window.orderBy(org_field, level_field).rowsBetween(Window.unboundedPreceding, -1)
    c = F.least(F.lit(min_per_stratum), F.col("size"))
    strata = strata.withColumn("_before", F.coalesce(F.sum(c).over(kw), F.lit(0)))
    strata = strata.withColumn("p1", F.greatest(F.lit(0), F.least(c, F.lit(n) - F.col("_before"))))
    remaining = F.lit(n) - strata.select(F.sum("p1")).scalar()
    already = F.when(F.col("size") >= min_per_stratum, F.lit(min_per_stratum)).otherwise(F.col("size"))
    avail = F.col("size") - already
    p2 = F.when(
        (remaining > 0) & (avail > 0),
        F.least(F.floor(F.col("size") / total * remaining), avail),
    ).otherwise(F.lit(0))
    alloc = strata.select(org_field, level_field, "p1", p2.cast("bigint").alias("p2"))

    picked = (
        _ranked_within(keyed, [org_field, level_field], id_field, seed, n)
        .join(alloc, [org_field, level_field])
        .where(F.col("_rn") <= F.col("p1") + F.col("p2"))
        .withColumn("sample_pass", F.when(F.col("_rn") <= F.col("p1"), F.lit(1)).otherwise(F.lit(2)))
        .drop("_rn", "p1", "p2")
    )
    needed = F.lit(n) - picked.select(F.count(F.lit(1))).scalar()
    rest = df.join(picked.select(id_field), id_field, "left_anti")
    # At most n candidates survive the global top-n (TakeOrderedAndProject);
    # the final rank runs over those n rows only.
    cand = rest.orderBy(hash_order(id_field, seed), F.col(id_field)).limit(n)
    top = (
        cand.withColumn("_rn", F.row_number().over(Window.orderBy(hash_order(id_field, seed), F.col(id_field))))
        .where(F.col("_rn") <= needed)
        .drop("_rn")
        .withColumn("sample_pass", F.lit(3))
    )
    return picked.unionByName(top)


def sample_by_strata(
    df: DataFrame,
    strata_config: DataFrame,
    seed: int = SEED,
    org_field: str = "org_unit",
    level_field: str = "level",
    id_field: str = "jd_id",
) -> DataFrame:
    """W05 + J11: min(requested, available) rows per requested stratum.

    ``strata_config`` has (org, level, count); it is joined on the keys (AQE
    broadcasts it when small).  Its largest count, read first, bounds the rank
    filter, so a stratum sends no more rows than any request needs.
    """
    largest = strata_config.agg(F.max("count")).first()[0] or 0
    ranked = _ranked_within(df, [org_field, level_field], id_field, seed, int(largest))
    return ranked.join(strata_config.withColumnRenamed("count", "_want"), [org_field, level_field]).where(
        F.col("_rn") <= F.col("_want")
    ).drop("_rn", "_want")


def missing_strata(df: DataFrame, strata_config: DataFrame, org_field: str = "org_unit", level_field: str = "level") -> DataFrame:
    """W05 warning rows: requested strata with no record."""
    return strata_config.join(df.select(org_field, level_field), [org_field, level_field], "left_anti")


def random_sample(df: DataFrame, n: int, seed: int = SEED, id_field: str = "jd_id") -> DataFrame:
    """N seeded rows (top-n by hash order, no full sort)."""
    return df.orderBy(hash_order(id_field, seed), F.col(id_field)).limit(n)


def random_sample_per_group(df: DataFrame, group: str, n: int, seed: int = SEED, id_field: str = "jd_id") -> DataFrame:
    """W06 per group."""
    return _ranked_within(df, [group], id_field, seed, n).drop("_rn")


def first_per_key(df: DataFrame, key: str, order: Column) -> DataFrame:
    """Keep the first row per key in the given order."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def not_sampled(df: DataFrame, sample: DataFrame, id_field: str = "jd_id") -> DataFrame:
    """Rows not yet sampled."""
    return df.join(sample.select(id_field), id_field, "left_anti")
