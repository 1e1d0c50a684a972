"""Every registered query against its SQL on the smallest tables; plan checks."""

import os

import pytest
from check_queries import compare

import __spark_entry__ as E

FOLDER = E.SMOKE
if not os.path.isdir(FOLDER):
    pytest.skip("no test tables here", allow_module_level=True)


#: Queries of the optional subpackage are tested with it.
OWN = [n for n in E.queries() if not any(n in m.queries() for m in E._extension())]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_query_has_sql():
    assert set(OWN) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", OWN)
def test_query(spark, name):
    assert compare(spark, FOLDER, name, E.queries()[name], E.oracle_sql()[name]).startswith("ok")


def test_entry(spark):
    assert E.entry(spark).columns == ["metric", "key", "value", "ordinal"]


def test_scans_read_what_they_need(spark):
    queries = E.queries()
    total = plan(queries["total_purchase_value"](spark, FOLDER))
    assert "EqualTo(event_type,purchase)" in total
    assert "ReadSchema: struct<event_type:string,value:double>" in total
    top = plan(queries["top_users"](spark, FOLDER))
    assert "TakeOrderedAndProject" in top and "ReadSchema: struct<user_id:bigint>" in top
    assert "ReadSchema: struct<>" in plan(queries["event_count"](spark, FOLDER))
    hour = plan(queries["odd_hour"](spark, FOLDER))
    assert "Exchange" not in hour and "GreaterThan(value,0.0)" in hour
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,value:double>" in hour
