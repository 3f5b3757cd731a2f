"""Driver contract smoke test on sf0.001."""

import os

import pytest

import __spark_entry__ as entry

SMOKE = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMOKE), reason="driver test data not present")
def test_entry_and_registry(spark):
    df = entry.entry(spark)
    assert df.columns == ["org_unit", "mean", "count"]
    assert df.count() > 0
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    # a cheap sample of registered queries resolves and runs on the smallest tables
    for name in ["a04_cleaning_stats", "g10_parse_corpus", "a32_item_frequency", "s02_record_explode"]:
        assert q[name](spark, SMOKE).count() >= 0
