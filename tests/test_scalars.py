
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidycell.functions import metadata as M
from tidycell.functions import scalars as S


def apply(spark, fn, texts, schema="t string"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, {schema}")
    return [r.v for r in df.select("i", fn(F.col("t")).alias("v")).orderBy("i").collect()]


def test_year(spark):
    cases = {"2020": 2020, "2021Q4": 2021, "2020-01": 2020, "": 2020, "invalid": 2020, None: 2020, "1991000000": 1991,
             "２０２２年": 2022, "year 1999 or 2001": 1999, "99": 2020}
    assert apply(spark, S.year, list(cases)) == list(cases.values())
    assert apply(spark, lambda c: S.year(c, None), ["invalid", "2020"]) == [None, 2020]


def test_quarter(spark):
    cases = {"2020Q1": 1, "2020Q4": 4, "2020-q3": 3, "2020": 0, "": 0, "2020Q5": 0, None: 0, "Q2": 2, "２０２０Q２": 2}
    assert apply(spark, S.quarter, list(cases)) == list(cases.values())


def test_month(spark):
    cases = {"2020-12": 12, "202001": 1, "20200115": 1, "2020": 0, "": 0, "2018000103": 0, "202099": 99, None: 0,
             "2020-1": 0, "202001 2020-03": 3, "２０２００７": 7, "x20200115": 1}
    assert apply(spark, S.month, list(cases)) == list(cases.values())


def test_measure_zero(spark):
    cases = {"1,000,000": 1000000.0, "0.123": 0.123, "": 0.0, "invalid": 0.0, "-": 0.0, None: 0.0, " 12 ": 12.0, "5d": 0.0,
             "nan": 0.0, "1_000": 0.0, "-1.5e3": -1500.0, "１２３": 123.0, ".5": 0.5, "1 000": 0.0}
    assert apply(spark, S.measure, list(cases)) == list(cases.values())


def test_measure_null(spark):
    cases = {"1,000": None, "12.5": 12.5, "": None, "-": None, "bad": None, None: 0.0, "-3": -3.0}
    assert apply(spark, lambda c: S.measure(c, "null"), list(cases)) == list(cases.values())


def test_measure_rejects_unknown_mode(spark):
    with pytest.raises(ValueError):
        S.measure(F.lit("x"), "ignore")


def test_legacy_year(spark):
    cases = {"2020": 2020, "1991000000": 1991000000, None: 2020, "2020Q1": None, "": None}
    assert apply(spark, S.legacy_year, list(cases)) == list(cases.values())


def test_period_bounds(spark):
    first = apply(spark, lambda c: S.period_bounds(c)[0], ["2018000103", "201801", None])
    last = apply(spark, lambda c: S.period_bounds(c)[1], ["2018000103", "201801", None])
    assert (first, last) == ([1, None, None], [3, None, None])


def test_normalised_name(spark):
    cases = {"Column  Name": "column_name", "column.name": "column_name", "人口": "column", "": "column", "__A--b__": "a_b", "年Year": "year"}
    assert apply(spark, S.normalised_name, list(cases)) == list(cases.values())
    assert [S.normalised_names([c])[0] for c in cases] == list(cases.values())
    assert S.normalised_names(["人口", "世帯", "A b", "a_b", "column"]) == ["column", "column_2", "a_b", "a_b_2", "column_3"]


def test_text_type(spark):
    cases = {"123": "INT", "-5": "INT", "123.45": "DOUBLE", "2020-01-01": "TIMESTAMP", "2020-01-01 10:00": "TIMESTAMP", "text": "STRING", "": "STRING", None: "STRING"}
    assert apply(spark, S.text_type, list(cases)) == list(cases.values())


def test_dataset_id_from_path(spark):
    cases = {"s3://b/raw/data/0004_chunk_001.json": "0004", "0001.json": "0001.json", "a/b_c/12_x_y.json": "12"}
    assert apply(spark, S.dataset_id_from_path, list(cases)) == list(cases.values())


def test_string_or_object(spark):
    cases = {'{"$":"text","@no":"1"}': "text", "plain": "plain", None: "N/A", '{"@no":"1"}': "N/A"}
    assert apply(spark, lambda c: S.string_or_object(c, "N/A"), list(cases)) == list(cases.values())


def test_table_link(spark):
    assert apply(spark, lambda c: S.table_link(c, "u="), ["00 0211-23", "abc", ""]) == ["u=00021123", None, None]


def test_digits_percent_grouping(spark):
    assert apply(spark, S.digits_only, ["007", "T01", "", None]) == [7, None, None, None]
    assert apply(spark, lambda c: S.percent_of(F.lit(1.0), c), [4.0, 0.0], "t double") == [25.0, None]
    assert apply(spark, S.grouped_digits, [1234567, 12], "t bigint") == ["1,234,567", "12"]


def test_record_total_and_filtering(spark):
    df = spark.createDataFrame([(1, None, [2, 3]), (2, 0, [4]), (3, 100000, [1]), (4, None, []), (5, None, [2, 0])], "i int, stated bigint, sizes array<bigint>")
    total = M.record_total(F.col("stated"), F.col("sizes"))
    got = [tuple(r) for r in df.select(total, M.requires_filtering(total)).collect()]
    assert got == [(6, False), (4, False), (100000, True), (None, None), (None, None)]


def test_fetch_mode(spark):
    assert apply(spark, M.fetch_mode, [100000, 100001], "t bigint") == ["single", "chunked"]
    assert apply(spark, M.fetch_records, [5, 2000000], "t bigint") == [5, 2000000]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.floats(allow_nan=False, allow_infinity=False).map(str), st.integers().map("{:,}".format), st.text(alphabet="0123456789.,-+eE Q年x", max_size=12)), min_size=1, max_size=40))
def test_measure_against_python(spark, texts):
    import re

    def expected(t):
        t = t.replace(",", "").strip()
        return float(t) if re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", t) else 0.0

    assert apply(spark, S.measure, texts) == [expected(t) for t in texts]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="0123456789-Qq x", max_size=14), min_size=1, max_size=40))
def test_time_parts_against_python(spark, texts):
    import re

    def month(t):
        for p in ("[0-9]{4}-([0-9]{2})", "[0-9]{4}([0-9]{2})[0-9]{2}", "[0-9]{4}([0-9]{2})"):
            m = re.search(p, t)
            if m:
                return int(m.group(1))
        return 0

    def quarter(t):
        m = re.search("Q([1-4])", t, re.I)
        return int(m.group(1)) if m else 0

    def year(t):
        m = re.search("([0-9]{4})", t)
        return int(m.group(1)) if m else 2020

    assert apply(spark, S.month, texts) == [month(t) for t in texts]
    assert apply(spark, S.quarter, texts) == [quarter(t) for t in texts]
    assert apply(spark, S.year, texts) == [year(t) for t in texts]


