import pytest
from pyspark.sql import functions as F

from tests.conftest import values
from tidycell import schemas
from tidycell.operators import quality as Q

SCHEMA = "year int, region string, value double"
CLEAN = [(2020, "01000", 1.0), (2020, "02000", 2.0), (2021, "01000", 3.0)]


@pytest.fixture()
def clean(rows):
    return rows(SCHEMA, *CLEAN)


def test_required_columns(clean, rows):
    assert Q.required_columns(clean, ["year", "value"]).first().valid
    row = Q.required_columns(clean, ["year", "unit", "month"]).first()
    assert (row.valid, row.missing_columns, row.actual_columns) == (False, ["unit", "month"], ["region", "value", "year"])
    empty = Q.required_columns(rows(SCHEMA), ["unit"]).first()
    assert (empty.valid, empty.missing_columns, empty.total_records) == (True, [], 0)


def test_null_counts(rows, clean):
    assert Q.null_counts(clean, ["year", "region"]).count() == 0
    df = rows("a string, b string, c int", ("", "x", 1), (None, "null", None), ("null", "y", 2))
    assert values(Q.null_counts(df, ["a", "b", "c"])) == [("a", 3, 3), ("b", 1, 3), ("c", 1, 3)]


def test_ranges(rows):
    df = rows("i int, v string", (0, "5"), (1, "-1"), (2, "11"), (3, "x"), (4, None), (5, "10"), (6, "0"))
    assert Q.out_of_range(df, "v", 0, 10).first().asDict() == dict(total_records=7, out_of_range_count=2, valid=False)
    assert values(Q.range_offenders(df, "v", ["i"], 0, 10), "i", "reason") == [(1, "Below minimum (0)"), (2, "Above maximum (10)")]
    assert Q.out_of_range(df, "v", minimum=-5).first().valid
    assert Q.out_of_range(df, "v", maximum=4).first().out_of_range_count == 3
    assert Q.range_offenders(df, "v", ["i"], 100, None, shown=2).count() == 2


def test_duplicates(rows, clean):
    assert Q.duplicate_summary(clean, ["year", "region"]).first().asDict() == dict(duplicate_count=0, total_duplicate_records=0, total_records=3, has_duplicates=False)
    df = rows(SCHEMA, *CLEAN, CLEAN[0], CLEAN[2], (None, None, 1.0), (None, None, 2.0))
    assert Q.duplicate_summary(df, ["year", "region"]).first().asDict() == dict(duplicate_count=3, total_duplicate_records=6, total_records=7, has_duplicates=True)
    assert values(Q.duplicate_details(df, ["year", "region"], 2)) == [(2020, "01000", 2), (2021, "01000", 2)]
    assert Q.duplicate_summary(rows(SCHEMA), ["year"]).first().asDict() == dict(duplicate_count=0, total_duplicate_records=0, total_records=0, has_duplicates=False)


def test_duplicate_texts(rows):
    df = rows("t string", ("a",), ("b",), ("a",), (None,), (None,), ("c",))
    assert values(Q.duplicate_texts(df, "t")) == [("a", 2), (None, 2)]


def test_quarantine_keeps_every_row(rows):
    df = rows(SCHEMA, *CLEAN, CLEAN[0], (2020, "03000", None), (1800, "", -1.0), (None, "01000", 5.0), (None, "01000", 6.0))
    rules = {"no_value": Q.is_blank("value"), "no_region": Q.is_blank("region"), "old": F.col("year") < 1900}
    good, bad = Q.quarantine(df, rules, ["year", "region"])
    assert values(good) == sorted(CLEAN[1:], key=repr)
    assert values(bad, "year", "region", "reasons") == sorted([
        (2020, "01000", ["duplicate"]), (2020, "01000", ["duplicate"]), (2020, "03000", ["no_value"]),
        (1800, "", ["no_region", "old"]), (None, "01000", ["duplicate"]), (None, "01000", ["duplicate"])], key=repr)
    assert good.count() + bad.count() == df.count()


@pytest.mark.parametrize("data,bad_rows", [([], 0), (CLEAN, 0), ([(2020, "x", None)] * 3, 3)])
def test_quarantine_extremes(rows, data, bad_rows):
    good, bad = Q.quarantine(rows(SCHEMA, *data), {"no_value": Q.is_blank("value")})
    assert (good.count(), bad.count()) == (len(data) - bad_rows, bad_rows)


def test_gate(rows):
    schema = "dataset_id string, year int, region_code string, value double"
    good = rows(schema, ("d", 2020, "1", 1.0), ("d", 2020, "2", 1.0))
    required = ["dataset_id", "year", "region_code", "value"]
    assert Q.gate(good, required, True).first().valid
    assert not Q.gate(good, required + ["unit"]).first().valid
    twice = good.unionByName(good)
    assert Q.gate(twice, required).first().valid
    row = Q.gate(twice, required, True).first()
    assert (row.valid, row.duplicate_keys, row.total_records) == (False, 2, 4)
    nulls = Q.gate(rows(schema, ("", 2020, "1", None)), required).first()
    assert (nulls.valid, nulls.null_dataset_id, nulls.null_value) == (False, 1, 1)
    assert Q.gate(rows(schema), required + ["unit"], True).first().valid


def test_completeness(rows):
    got = Q.completeness(rows("d string", ("a",), ("a",), ("b",)), rows("d string, expected int", ("a", 4), ("b", 0), ("c", 3)), "d")
    assert values(got) == [("a", 4, 2, 0.5), ("b", 0, 1, 0.0), ("c", 3, 0, 0.0)]


def test_summary(clean):
    got = values(Q.summary(clean, {"a": F.col("value") > 1, "b": F.col("year") < 0}), "rule", "failures", "total")
    assert got == [("a", 2, 3), ("b", 0, 3)]


def test_registry(spark):
    reg = Q.registry(spark)
    assert reg.filter("is_partition").count() == sum(len(schemas.partition_columns(d)) for d in schemas.DOMAINS)
    assert reg.filter("role = 'measure'").count() == len(schemas.DOMAINS)
    assert Q.schema_conflicts(reg).count() == 0


def test_first_per_key(rows):
    df = rows("k string, pos int, v string", ("a", 2, "late"), ("a", 1, "first"), (None, 5, "n2"), (None, 4, "n1"), ("b", 1, "only"))
    assert values(Q.first_per_key(df, ["k"], ["pos"]), "k", "v") == [("a", "first"), ("b", "only"), (None, "n1")]
