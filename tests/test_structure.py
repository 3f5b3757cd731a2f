"""Section parser on hand-written texts."""

from scriptorium.operators import structure as S


def _parse(spark, text):
    df = spark.createDataFrame([("1", text)], "jd_id string, jd_text string")
    return [r.asDict() for r in S.parse_corpus(df).orderBy("ord").collect()]


def test_colon_caps_and_known_headers(spark):
    text = "Intro text that is long enough to be a preamble.\nSummary:\n" + "a" * 30 + "\nWHAT WE OFFER\n" + "b" * 30
    secs = _parse(spark, text)
    assert [s["section_type"] for s in secs] == ["summary", "summary", "benefits"]
    assert secs[0]["header"] == "preamble"
    assert secs[1]["header"] == "Summary" and secs[1]["content"] == "a" * 30


def test_no_headers_and_empty(spark):
    secs = _parse(spark, "just some words without any header at all")
    assert len(secs) == 1 and secs[0]["section_type"] == "unstructured"
    assert _parse(spark, "") == []


def test_dedupe_window_of_ten(spark):
    # colon header and the known pattern inside it start together: one header kept
    secs = _parse(spark, "Key Responsibilities:\n" + "x" * 40)
    assert len(secs) == 1 and secs[0]["section_type"] == "responsibilities"


def test_custom_patterns_append_a_type(spark):
    df = spark.createDataFrame([("1", "Thank you:\n" + "z" * 30)], "jd_id string, jd_text string")
    rows = S.parse_corpus(df, custom_patterns={"closing": [r"thank\s+you"]}).collect()
    assert rows[0]["section_type"] == "closing"


def test_every_known_phrase_near_the_start_of_a_line_is_a_header(spark):
    df = spark.createDataFrame([("1", "perks               benefits\nx"), ("2", "some words of a line then benefits\nx")], "jd_id string, jd_text string")
    got = {(r.jd_id, r.start, r.text) for r in S.headers_table(df).collect()}
    assert got == {("1", 0, "perks"), ("1", 20, "benefits")}


def test_section_filter_deals_no_text_by_its_type(spark):
    rows = [("1", "summary", "x" * 60), ("2", "summary", "y" * 60), ("3", "benefits", "z" * 60), ("4", "summary", "short"), ("5", "other", "o" * 60), ("6", "other", "p" * 60), ("7", None, "q" * 60), ("8", "summary", None)]
    out = S.section_filter(spark.createDataFrame(rows, "jd_id string, section_type string, content string"), ["summary", "benefits"], 50)
    assert sorted(r["jd_id"] for r in out.collect()) == ["1", "2"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
