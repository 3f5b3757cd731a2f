"""Edge cases of FIXTURES.md section 3: headers, dates, sampling minimums."""

from pyspark.sql import functions as F

from scriptorium.functions.dates import parse_date
from scriptorium.operators import quality, sampling
from scriptorium.operators import structure as S


def _headers(spark, text, deduped=True):
    df = spark.createDataFrame([("1", text)], "jd_id string, jd_text string")
    return [(r["start"], r["text"], r["rule"]) for r in S.headers_table(df, deduped=deduped).orderBy("start", "prio").collect()]


def test_caps_word_limit(spark):
    six = "ONE TWO THREE FOUR FIVE SIX"
    seven = "ONE TWO THREE FOUR FIVE SIX SEVEN"
    assert (0, six, "caps") in _headers(spark, six + "\n" + "x" * 30, deduped=False)
    assert not any(r == "caps" for _, _, r in _headers(spark, seven + "\n" + "x" * 30, deduped=False))


def test_who_we_are_is_team_before_company(spark):
    df = spark.createDataFrame([("who we are",), ("About the company",)], "h string")
    assert [r[0] for r in df.select(S.classify_header(F.col("h"))).collect()] == ["team_info", "company_info"]


def test_starts_nine_and_ten_apart(spark):
    # colon headers at 0 and 9: the second is inside the window; at 0 and 10 both stay
    nine = "Abcdefg:\nHijklmno:\n" + "z" * 30
    ten = "Abcdefgh:\nIjklmnop:\n" + "z" * 30
    assert [h[0] for h in _headers(spark, nine) if h[2] == "colon"] == [0]
    assert [h[0] for h in _headers(spark, ten) if h[2] == "colon"] == [0, 10]


def test_known_pattern_needs_short_prefix(spark):
    near = _headers(spark, "- our team\n" + "y" * 30, deduped=False)
    far = _headers(spark, "quite a long prefix our team\n" + "y" * 30, deduped=False)
    assert any(r == "team_info" for _, _, r in near) and not any(r == "team_info" for _, _, r in far)


def test_date_parsing(spark):
    df = spark.createDataFrame([("2024-03-05",), ("03/05/2024",), ("garbage",), (None,)], "s string")
    got = [r[0] for r in df.select(F.date_format(parse_date(F.col("s")), "yyyy-MM-dd")).collect()]
    assert got == ["2024-03-05", "2024-03-05", None, None]


def _merged(spark, rows):
    df = spark.createDataFrame(rows, "jd_id string, posting_date string, average_score double")
    return df.withColumn("is_gold_standard", F.lit(False))


def test_recency_needs_five_valid_rows(spark):
    few = _merged(spark, [(str(i), "2024-01-0%d" % (i + 1), 3.0) for i in range(4)] + [("x", "garbage", 4.0)])
    assert quality.quality_by_period(few, "quarter").count() == 0
    assert quality.quality_trend(few).count() == 0


def test_single_date_gives_no_correlation(spark):
    same = _merged(spark, [(str(i), "2024-01-01", float(i % 5)) for i in range(8)])
    assert quality.quality_date_correlation(same).count() == 0
    assert quality.quality_date_range(same).first()["span_days"] == 0


def test_stratum_smaller_than_minimum(spark):
    rows = [(str(i), "big", "l") for i in range(20)] + [("s1", "small", "l")]
    df = spark.createDataFrame(rows, "jd_id string, org_unit string, level string")
    s = sampling.sample_stratified(df, n=6, min_per_stratum=2).collect()
    assert len(s) == 6 and sum(1 for r in s if r["org_unit"] == "small") == 1


def test_terms_of_any_length_are_found(spark):
    from scriptorium.operators import requirements as Q

    texts = spark.createDataFrame([("1", "Knows Large Scale Data Processing and sql"), ("2", None), ("3", "")], "jd_id string, text string")
    terms = spark.createDataFrame([("large scale data processing", "lsdp", "domain"), ("sql", "SQL", "technical"), (None, "x", "soft")], "term string, canonical string, category string")
    for chars in (1 << 20, 0):
        got = {(r.jd_id, r.item) for r in Q.extract_requirements(texts, terms, broadcast_chars=chars).collect()}
        assert got == {("1", "lsdp"), ("1", "SQL")}


def test_strata_requests_above_a_thousand_rows(spark):
    from scriptorium.operators import sampling

    rows = spark.range(3000).selectExpr("CAST(id AS STRING) AS jd_id", "'o' AS org_unit", "'l' AS level")
    want = spark.createDataFrame([("o", "l", 2500), ("none", "l", 5)], "org_unit string, level string, count bigint")
    assert sampling.sample_by_strata(rows, want).count() == 2500
    assert sampling.sample_by_strata(rows, want.limit(0)).count() == 0


def test_items_are_not_compared_after_the_terms_are(spark):
    from scriptorium.operators import requirements as Q

    # An id with two texts, a repeated word, a null id, an item of two terms and a term of two items.
    texts = spark.createDataFrame([("1", "sql and SQL"), ("1", "sql too"), (None, "sql"), (None, "sql"), ("2", "spark and pyspark")], "jd_id string, text string")
    plain = [("sql", "SQL", "technical"), ("sql", "SQL", "tools"), ("SQL", None, "tools"), ("spark", "Spark", "tools")]
    for terms in (plain, [*plain, ("pyspark", "Spark", "tools")]):
        for chars in (1 << 20, 0):
            found = Q.extract_requirements(texts, spark.createDataFrame(terms, "term string, canonical string, category string"), broadcast_chars=chars)
            want = {(i, c, "required", x) for i in ("1", None) for c, x in (("technical", "SQL"), ("tools", "SQL"), ("tools", None))} | {("2", "tools", "required", "Spark")}
            assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)
            plan = found._jdf.queryExecution().optimizedPlan().toString()
            # With one term for every item nothing is grouped by the items.
            assert any("Aggregate" in line and "item" in line and "kind" in line for line in plan.splitlines()) == (len(terms) > 4)
