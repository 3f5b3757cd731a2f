"""Hand-written cases for the text functions (FIXTURES.md section 3)."""

from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import cleaning


def _one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("o")).first()["o"]


def test_strip_html_decodes_then_removes_tags(spark):
    assert _one(spark, T.strip_html, "&lt;b&gt;x") == " x"
    assert _one(spark, T.strip_html, "<p>a</p>") == " a "
    assert _one(spark, T.strip_html, "a &amp; b &copy; &#39;q&#39;") == "a & b © 'q'"


def test_squeeze_unicode_blanks(spark):
    assert _one(spark, T.squeeze_whitespace, "a  b\n\tc  ") == "a b c"
    assert _one(spark, T.squeeze_whitespace, "x\x1cy") == "x y"


def test_mojibake_order_kept(spark):
    assert _one(spark, T.fix_mojibake, "itâ€™s â€œokâ€\x9d") == "it's \"ok\"\x9d"
    assert _one(spark, T.fix_mojibake, "Â\x00a") == "a"
    # the bare rule fires first, so the dash rules never apply
    assert _one(spark, T.fix_mojibake, 'â€"') == '""'


def test_clean_text_flags_and_lengths(spark):
    df = spark.createDataFrame([("1", None), ("2", ""), ("3", "<b>hi</b>  there"), ("4", "x" * 49), ("5", "y" * 50)], "jd_id string, jd_text string")
    rows = {r["jd_id"]: r for r in cleaning.with_clean_text(df).select("jd_id", "_clean.*").collect()}
    assert rows["1"]["clean"] is None and rows["1"]["len_before"] is None
    assert rows["2"]["clean"] == "" and not rows["2"]["html_changed"]
    assert rows["3"]["clean"] == "hi there" and rows["3"]["html_changed"] and rows["3"]["ws_changed"]
    kept = {r["jd_id"] for r in cleaning.clean_corpus(df).collect()}
    assert kept == {"5"}


def test_slug_preview_fence_and_names(spark):
    assert _one(spark, T.slugify, "M&A / Risk (EMEA)") == "m-a-risk-emea"
    assert _one(spark, lambda c: T.preview(c, 3), "abcd") == "abc..."
    assert _one(spark, lambda c: T.preview(c, 3), "abc") == "abc"
    assert _one(spark, T.strip_code_fence, "  ```json\n{\"a\":1}\n```  ") == '{"a":1}'
    df = spark.createDataFrame([(["Senior Data Engineer", "lower case title"], 7), ([], 3)], "titles array<string>, c int")
    names = [r[0] for r in df.select(T.fallback_name(F.col("titles"), F.col("c"))).collect()]
    assert names == ["Senior Data Engineer", "Cluster 3"]


def test_cluster_label(spark):
    df = spark.createDataFrame([(-2,), (-1,), (4,)], "c int")
    assert [r[0] for r in df.select(T.cluster_label("c")).collect()] == ["Unmatched", "Noise", "Cluster 4"]
