"""Evaluation import rules and rubric."""

from scriptorium.operators import quality


def test_csv_import_rules(spark):
    rows = [
        ("1", "4", "", "TRUE", 0),
        ("1", "5", "", "true", 1),   # same id twice: the last row wins
        ("2", None, None, "yes", 2),  # neither completeness nor overall: ignored
        (None, "3", "", "TRUE", 3),   # no id: ignored
        ("3", None, "4", "no", 4),    # overall only: kept
    ]
    raw = spark.createDataFrame(rows, "jd_id string, eval_completeness string, eval_overall_score string, eval_is_gold_standard string, o long")
    got = {r["jd_id"]: r for r in quality.import_csv_evaluations(raw, order_col="o").collect()}
    assert set(got) == {"1", "3"}
    assert got["1"]["completeness"] == 5 and got["1"]["is_gold_standard"] is True
    assert got["3"]["overall_score"] == 4 and got["3"]["is_gold_standard"] is False
    assert got["3"]["average_score"] is None


def test_average_score(spark):
    df = spark.createDataFrame([(1, 2, None, 4, 5)], "completeness int, clarity int, specificity int, compliance int, actionability int")
    assert quality.with_rubric(df).first()["average_score"] == 3.0
