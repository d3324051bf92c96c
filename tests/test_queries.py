"""Every query with SQL gives the rows of its SQL; every other one gives some."""

import pytest
from compare import connect, rows

from driftline.plans import QUERIES, SQL


@pytest.fixture(scope="module")
def db(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, db, name):
    got = QUERIES[name](spark, small).toPandas()
    if name not in SQL:
        assert len(got) > 0
        return
    want = db.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(5).count() == 5
    assert set(SQL) <= set(entry.oracle_sql()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_no_cartesian_products_or_python_in_the_flagship(spark, small):
    plan = QUERIES["diff_events"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "Python" not in plan and "Arrow" not in plan
    assert "ReadSchema: struct<l_partkey" in plan or "ReadSchema" in plan
