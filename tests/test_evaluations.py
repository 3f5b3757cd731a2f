import json

from scriptorium.operators import quality as Q
from scriptorium.sources import records as R


def test_json_round_trip(spark, tmp_path):
    sample = spark.createDataFrame([("1", "text", "A", 4, "good", True), ("2", "", None, None, None, None)], "jd_id string, jd_text string, level string, clarity int, clarity_notes string, is_gold_standard boolean")
    out = str(tmp_path / "export.json")
    R.write_table(Q.evaluation_records(sample, ["jd_text", "level", "absent"]), out, fmt="json", ignoreNullFields="false")
    got = {r["jd_id"]: r for r in Q.import_json_evaluations(R.read_evaluations(spark, out, Q.EVALUATION_SCHEMA, lines=True)).collect()}
    assert set(got) == {"1", "2"}
    assert (got["1"]["clarity"], got["1"]["clarity_notes"], got["1"]["is_gold_standard"], got["1"]["average_score"]) == (4, "good", True, 4.0)
    assert (got["2"]["clarity"], got["2"]["clarity_notes"], got["2"]["is_gold_standard"], got["2"]["average_score"]) == (None, "", False, None)


def test_json_array_rules(spark, tmp_path):
    rows = [
        {"jd_data": {"jd_id": 7, "other": [1]}, "evaluation": {"completeness": 2}},
        {"jd_data": {"jd_id": "7"}, "evaluation": {"completeness": 5, "overall_score": 3}},
        {"jd_data": {"jd_id": "8"}, "evaluation": {}},
        {"jd_data": {"jd_id": ""}, "evaluation": {"completeness": 1}},
        {"jd_data": {}, "evaluation": {"completeness": 1}},
        {"evaluation": {"completeness": 1}},
        {"jd_data": {"jd_id": "9"}},
    ]
    (tmp_path / "all.json").write_text(json.dumps(rows))
    raw = R.read_evaluations(spark, str(tmp_path / "all.json"), Q.EVALUATION_SCHEMA)
    got = Q.import_json_evaluations(raw, order_col="_file_order").collect()
    assert [(r["jd_id"], r["completeness"], r["overall_score"], r["overall_notes"]) for r in got] == [("7", 5, 3, "")]
