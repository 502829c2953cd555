"""Every registered query against its SQL check on the smallest tables."""

import pytest

import __spark_entry__ as spark_entry
from carelake.registry import catalog
from tools.check import compare, connect

ORACLES = catalog.ORACLES
PYTHON_TASKS = {"semantic_candidate", "best_match_per_request"}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_matches_sql(name, spark, sf, con):
    df = catalog.QUERIES[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert name in PYTHON_TASKS or "Python" not in plan and "Pandas" not in plan
    if name in ORACLES:
        assert compare(con, df, ORACLES[name]) == ""
    else:
        assert df.count() > 0


def test_every_query_has_its_sql():
    assert set(catalog.QUERIES) == set(ORACLES)


def test_entry_registers_the_library():
    assert set(catalog.QUERIES) <= set(spark_entry.queries()) and set(ORACLES) <= set(spark_entry.oracle_sql())


def test_entry_has_rows(spark):
    assert spark_entry.entry(spark).limit(1).count() == 1
