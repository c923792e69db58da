"""The physical plans the operators are meant to get."""

import datetime as dt

import pytest

from tidycell.operators import aggregates as A
from tidycell.plans.analysis import analyze
from tidycell.sources import tables
from workloads import views as V


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "economy")
    tables.append(spark, V.economy(spark, sf), path, "economy")
    return tables.read_domain(spark, path, "economy")


def test_partition_pruning(stored):
    scan = plan(stored.filter("year = 1998 AND region_code = '01000'"))
    assert "PartitionFilters: [isnotnull(year" in scan and "region_code" in scan.split("PartitionFilters: [")[1].split("]")[0]


def test_column_pruning(stored):
    assert "ReadSchema: struct<value:double>" in plan(stored.select("year", "value").filter("year = 1998"))


def test_predicate_pushdown(stored):
    assert "PushedFilters: [IsNotNull(indicator), EqualTo(indicator,1-URGENT)]" in plan(stored.filter("indicator = '1-URGENT'"))


def test_report_reads_two_columns_and_combines_before_the_shuffle(stored):
    text = plan(A.by_year_region(stored))
    assert "TakeOrderedAndProject" in text and "ReadSchema: struct<value:double>" in text
    assert text.count("Exchange") == 1 and "partial_sum" in text


def test_mapping_needs_no_shuffle_and_no_python(spark, sf):
    text = plan(V.mapped(spark, sf, "education", "cells_customer"))
    assert "Exchange" not in text and "Python" not in text


def test_outliers_share_one_subquery(stored):
    df = A.outliers(stored, ["year"])
    df.collect()
    text = plan(df)
    assert "ReusedSubquery" in text and "NestedLoop" not in text and "Cartesian" not in text


@pytest.mark.parametrize("kind,reports", [("basic", 4), ("advanced", 4), ("statistical", 6)])
def test_analyses(spark, sf, kind, reports):
    found = analyze(V.sales(spark, sf), kind)
    assert len(found) == reports and all(df.count() > 0 for name, df in found.items() if name != "outliers")
    with pytest.raises(ValueError):
        analyze(V.sales(spark, sf), "unknown")


def test_stamp_is_fixed(spark, sf):
    assert V.sales(spark, sf).first().updated_at == dt.datetime(2024, 1, 1)
