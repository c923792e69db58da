import datetime as dt

import pytest
from pyspark.errors import ParseException
from pyspark.sql import functions as F

from tests.conftest import values
from tidycell.operators import filters as X
from tidycell.schemas import cell_schema


@pytest.fixture()
def codes(rows):
    return rows("category_id string, code string, name string, code_pos int",
                ("area", "13000", "Tokyo", 1), ("area", "01000", "Hokkaido", 0), ("area", "13100", "Wards", 2), ("area", "99", "13000", 3),
                ("area", "", "nameless", 4), ("area", "777", "", 5), ("time", "2020000000", "2020", 0), ("time", "dup1", "Same", 1), ("time", "dup2", "Same", 2))


def test_resolve(rows, codes):
    wanted = rows("n int, category_id string, wanted string",
                  (0, "area", "Tokyo"), (1, "area", "01000"), (2, "area", "13000"), (3, "area", "131"), (4, "area", "1"), (5, "area", "zzz"),
                  (6, "time", "Same"), (7, "zone", "Tokyo"), (8, "time", "2020"), (9, "area", "777"), (10, "area", ""))
    got = {r.n: (r.code, r.match) for r in X.resolve(wanted, codes).collect()}
    assert got == {
        0: ("13000", "label"), 1: ("01000", "code"), 2: ("99", "label"),  # a label equal to the text beats the code
        3: ("13100", "partial"), 4: ("01000", "partial"), 5: (None, None), 6: ("dup1", "label"), 7: (None, None),
        8: ("2020000000", "label"), 9: (None, None), 10: ("01000", "partial")}


def test_resolve_agrees_with_brute_force(spark, codes):
    listed = [r for r in codes.orderBy("code_pos").collect() if r.code and r.name]
    texts = sorted({t[i:j] for r in listed for t in (r.code, r.name) for i in range(len(t)) for j in range(i + 1, len(t) + 1)})
    requests = spark.createDataFrame([(c, t) for c in ("area", "time") for t in texts], "category_id string, wanted string")

    def brute(category, text):
        mine = [r for r in listed if r.category_id == category]
        for hit in ([r.code for r in mine if r.name == text], [r.code for r in mine if r.code == text], [r.code for r in mine if text in r.code]):
            if hit:
                return hit[0]
        return None

    for r in X.resolve(requests, codes).collect():
        assert r.code == brute(r.category_id, r.wanted), (r.category_id, r.wanted)


def test_unknown_categories_and_options(rows, codes):
    wanted = rows("n int, category_id string, wanted string", (0, "area", "x"), (1, "zone", "y"))
    assert values(X.unknown_categories(wanted, codes), "n") == [(1,)]
    assert values(X.options(codes, 2), "category_id", "code") == [("area", "01000"), ("area", "13000"), ("time", "2020000000"), ("time", "dup1")]


def test_apply_resolved(spark, rows, codes):
    cells = spark.createDataFrame([(None, None, None, None, None, None, None, a, t, None, "1") for a, t in (("13000", "2020000000"), ("01000", "2020000000"), ("13000", "x"))], cell_schema())
    resolved = X.resolve(rows("category_id string, wanted string", ("area", "Tokyo"), ("time", "2020")), codes)
    assert values(X.apply_resolved(cells, resolved, ["area", "time"]), "`@area`", "`@time`") == [("13000", "2020000000")]


def test_simple_predicates(rows):
    df = rows("`@a` string, b string", ("1", "x"), ("1", ""), (None, None))
    assert df.filter(X.all_equal({"@a": "1", "b": "x"})).count() == 1
    assert df.filter(X.all_equal({})).count() == 3
    assert df.filter(X.non_null("@a")).count() == 2
    assert df.filter(X.non_empty("b")).count() == 1


def test_selectivity(rows):
    df = rows("a int", (1,), (2,), (3,), (4,))
    assert X.selectivity(df, F.col("a") > 1).first().asDict() == dict(fetched=3, available=4, percent=75.0, is_empty=False)
    assert X.selectivity(df, F.col("a") > 9).first().is_empty
    assert X.selectivity(rows("a int"), F.col("a") > 9).first().percent is None


def test_updated_since_is_strict(rows):
    day = lambda d: dt.datetime(2024, 1, d)
    sets = rows("dataset_id string, updated_at timestamp", ("same", day(1)), ("newer", day(2)), ("older", day(1)), ("never", day(1)))
    last = rows("dataset_id string, last_ingested_at timestamp", ("same", day(1)), ("newer", day(1)), ("older", day(3)))
    assert values(X.updated_since(sets, last), "dataset_id") == [("never",), ("newer",)]


def test_custom_sql_is_read_only(spark, rows):
    df = rows("a int", (3,), (1,), (2,))
    assert X.custom_sql(spark, " with q as (select a from t1) select sum(a) s from q;", {"t1": df}).first().s == 6
    assert [r.a for r in X.custom_sql(spark, "select a from t1 order by a desc -- newest first", {"t1": df}).collect()] == [3, 2, 1]
    for statement in ("DROP TABLE x", "insert into t1 values (1)", "CREATE TABLE z (a int)", "set a=b", "with q as (select 1 a) insert into t1 select a from q", "from t1 insert into t1 select a"):
        with pytest.raises(ParseException):
            X.custom_sql(spark, statement, {})


def test_selected(rows):
    assert values(X.selected(rows("id int, v string", (1, "a"), (2, "b"), (2, "c")), rows("id int", (2,), (2,)), "id")) == [(2, "b"), (2, "c")]


def test_selected_ids_prune_partitions_at_run_time(spark, tmp_path):
    from tidycell.sources import tables

    tables.write_by(spark.range(3000).selectExpr("id", "id % 30 AS dataset_id"), str(tmp_path / "t"), "dataset_id")
    spark.range(30).selectExpr("id AS dataset_id", "id % 10 AS kind").write.parquet(str(tmp_path / "ids"))
    stored = spark.read.schema("id bigint, dataset_id bigint").parquet(str(tmp_path / "t"))
    got = X.selected(stored, spark.read.parquet(str(tmp_path / "ids")).filter("kind = 3"), "dataset_id")
    assert sorted({r.dataset_id for r in got.select("dataset_id").collect()}) == [3, 13, 23] and got.count() == 300
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
