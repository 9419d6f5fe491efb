import pytest

from conftest import SF, assert_matches_oracle
from fieldrollup import queries as core


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_oracle(spark, name):
    assert_matches_oracle(spark, name, core.queries()[name], core.oracle_sql()[name])


def test_oracle_keys():
    assert set(core.oracle_sql()) <= set(core.queries())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_rollup_plan(spark):
    df = core.monthly_rollup(spark, SF)
    df.collect()
    text = df._jdf.queryExecution().toString()
    plan = text.split("== Physical Plan ==")[1].split("Initial Plan")[0]
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange ") == 2
    assert "Python" not in plan and "PushedFilters" in plan
    assert "GreaterThanOrEqual(l_shipdate" in plan
