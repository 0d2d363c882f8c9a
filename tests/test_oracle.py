"""Every registered query against its SQL on the smallest tables; and what no plan may hold."""

import pytest

import __spark_entry__ as entry
import verify

QUERIES = entry.queries()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return verify.connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, con):
    df = QUERIES[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name in SQL:
        ok, note = verify.compare(df, con, SQL[name])
        assert ok, note
    else:
        assert df.count() > 0


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 1 and rows[0]["buffer_size"] == 1000


def test_sql_has_a_query_each():
    assert set(SQL) <= set(QUERIES)
