"""Archetype record, top skills merge order, names and ids."""

from pyspark.sql import functions as F

from scriptorium.operators import archetypes as A
from scriptorium.operators import naming as N


def _inputs(spark):
    assign = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("n", -1), ("d", 2)], "jd_id string, cluster int")
    meta = spark.createDataFrame(
        [("a", "Senior Data Engineer", "EMEA", "IT", "L3", 2, 5), ("b", "Senior Data Engineer", "EMEA", "IT", "L3", 4, None),
         ("c", "Analyst", "", "Ops", "L2", None, None), ("d", "lower title", "APAC", "IT", "L1", 1, 2), ("n", "x", "EMEA", "IT", "L1", 1, 1)],
        "jd_id string, title string, division string, function string, level string, years_min int, years_preferred int",
    )
    items = spark.createDataFrame(
        [("a", 1, "technical", "required", "sql"), ("a", 2, "technical", "preferred", "python"), ("b", 1, "domain", "preferred", "sql"),
         ("b", 2, "tools", "required", "git"), ("d", 1, "soft", "required", "talk"), ("n", 1, "technical", "required", "noise")],
        "jd_id string, pos int, category string, kind string, item string",
    )
    return assign, meta, items


def test_record_counts_and_noise(spark):
    assign, meta, items = _inputs(spark)
    r = {x["cluster"]: x for x in A.archetype_records(assign, meta, items).collect()}
    assert set(r) == {1, 2}  # noise excluded
    assert r[1]["member_count"] == 2 and r[1]["member_total"] == 3  # c has no extraction
    assert r[1]["representative_titles"][0] == "Senior Data Engineer"
    assert r[1]["years_min_median"] == 3.0 and r[1]["range_low"] == 2 and r[1]["range_high"] == 5
    div = [(d["value"], d["share"]) for d in r[1]["division"]]
    assert div == [("EMEA", 1.0)]  # empty value left out of the numerator only
    assert A.archetype_members(assign).count() == 4


def test_top_skills_later_map_wins(spark):
    assign, meta, items = _inputs(spark)
    freq = A.item_frequency(A.exclude_noise(assign), items)
    top = {(r["cluster"], r["item"]): r["freq"] for r in A.top_skills(freq).collect()}
    # 'sql' is technical/required (1/2) and domain/preferred (1/2): the later map's value is kept
    assert top[(1, "sql")] == 0.5 and (1, "git") not in top


def test_names_and_unique_ids(spark):
    titles = spark.createDataFrame(
        [(1, 1, "Senior Data Engineer"), (2, 1, "Senior Data Engineer"), (3, 1, "lower case")], "cluster int, rank int, title string"
    )
    got = {r["cluster"]: (r["archetype_name"], r["archetype_id"]) for r in N.name_archetypes(titles).collect()}
    assert got[1] == ("Senior Data Engineer", "senior-data-engineer")
    assert got[2] == ("Senior Data Engineer", "senior-data-engineer-2")
    assert got[3] == ("Cluster 3", "cluster-3")
