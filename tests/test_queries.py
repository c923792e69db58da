"""Every registered query against its SQL, on the smallest data set, and its plan."""

import pytest

import __spark_entry__ as entry
from tests.compare import check, duck
from workloads import QUERIES, SQL

# Only SQL that has no exact counterpart may be missing.
ROWS_ONLY = set()
MAY_BE_EMPTY = {"dq04_duplicate_texts", "fl10_cross_tab_cell"}
# Joins that pair rows, and Python that works row by row.
UNWANTED = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas")


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, con, name):
    plans = []

    def run(spark, sf):
        df = QUERIES[name](spark, sf)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    result, _ = check(spark, con, name, run, SQL.get(name), sf)
    assert result.startswith("ok") or (result == "EMPTY" and name in MAY_BE_EMPTY), result
    assert not [operator for operator in UNWANTED if operator in plans[0]]


def test_only_inexact_queries_lack_sql():
    assert set(QUERIES) - set(SQL) == ROWS_ONLY


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["year", "region_code", "record_count"] and df.count() > 0
    assert entry.queries().keys() >= QUERIES.keys() and entry.oracle_sql().items() >= SQL.items()
