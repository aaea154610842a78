"""Every registered query with an oracle matches DuckDB on the smallest tables;
entry() runs and the contract functions agree on names."""

import pytest

import __spark_entry__ as se
from tests.oracle_compare import compare

SF = "/root/testdata/sf0.001"


def test_contract_names():
    q, o = se.queries(), se.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60


def test_entry_runs(spark):
    df = se.entry(spark)
    assert df.count() > 0
    assert "churn_probability" in df.columns and "expected_value" in df.columns


@pytest.mark.parametrize("name", sorted(se.oracle_sql()))
def test_query_matches_oracle(spark, name):
    res = compare(spark, SF, [name], verbose=False)[name]
    assert res["schema"], res
    assert res["spark_rows"] == res["oracle_rows"], res
    assert res["values"], res
