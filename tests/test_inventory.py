import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import values
from tidycell import schemas
from tidycell.operators import errors as E
from tidycell.operators import inventory as I

NOW = dt.datetime(2024, 1, 1)
INVENTORY = "id string, name string, domain string, priority int, status string, added_pos int"


def test_register(rows):
    schema = "dataset_id string, dataset_name string, domain string, ingestion_status string, ingestion_timestamp timestamp, table_name string, survey_date string"
    df = rows(schema, ("1", "n", "economy", "pending", NOW, "economy_data", "2020-01-02"), ("2", None, "economy", "pending", NOW, "economy_data", None))
    got = I.register(df, NOW)
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in schemas.INVENTORY]
    row = got.first()
    assert (row.survey_date, row.total_records, row.organization, row.error_message, row.created_at) == (dt.date(2020, 1, 2), 0, "", None, NOW)
    assert got.count() == 1 and values(I.refused(df), "dataset_id") == [("2",)]
    with pytest.raises(ValueError):
        I.register(df.drop("table_name"), NOW)


def test_status(rows):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    log = rows("dataset_id string, status string, ts timestamp, n int", ("a", "pending", t(1), 0), ("a", "processing", t(5), 1), ("a", "completed", t(5), 2), ("b", "failed", t(3), 3), ("b", "odd", t(9), 4))
    assert I.status_events(log).count() == 4
    known = I.status_events(log)
    assert values(I.latest(known, "dataset_id", [F.desc("ts"), F.desc("n")]), "dataset_id", "status") == [("a", "completed"), ("b", "failed")]
    assert values(I.transitions(known, "dataset_id", "ts", "n"), "n", "from_status", "status") == [
        (0, None, "pending"), (1, "pending", "processing"), (2, "processing", "completed"), (3, None, "failed")]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 200), st.sampled_from(["pending", "failed", "completed"])), min_size=1, max_size=30), st.sampled_from(["hour", "day", "month"]))
def test_transitions_do_not_depend_on_the_span(spark, events, span):
    data = [(d, s, NOW + dt.timedelta(hours=7 * h), i) for i, (d, h, s) in enumerate(events)]
    got = {r.n: r.from_status for r in I.transitions(spark.createDataFrame(data, "d string, status string, ts timestamp, n int"), "d", "ts", "n", span).collect()}
    last, want = {}, {}
    for d, s, ts, n in sorted(data, key=lambda e: (e[2], e[3])):
        want[n] = last.get(d)
        last[d] = s
    assert got == want


@pytest.fixture()
def inventory(rows):
    return rows(INVENTORY, ("a", "A", "economy", 5, "pending", 0), ("b", "B", "labor", 9, "pending", 1), ("c", "C", "labor", 9, "pending", 2), ("d", "D", "labor", 10, "completed", 3), ("e", "E", "economy", 1, "failed", 4))


def test_selection(inventory):
    assert I.next_batch(inventory).first().id == "b"
    assert [r.id for r in I.next_batch(inventory, 5, 6).collect()] == ["b", "c"]
    assert I.next_batch(inventory.filter("status <> 'pending'")).count() == 0
    assert values(I.listed(inventory, "pending", "labor"), "id") == [("b",), ("c",)]
    assert I.listed(inventory).count() == 5


def test_additions(rows, inventory):
    new = rows(INVENTORY, ("a", "again", "economy", 5, "x", 0), ("f", "", "weather", 11, None, 1), ("f", "second", "economy", 5, None, 2), ("g", "G", "trade", 0, None, 3), ("h", None, "labor", 10, None, 4))
    assert values(I.additions(new, inventory), "id", "name", "domain", "priority", "status") == [
        ("f", "Dataset f", "generic", 5, "pending"), ("g", "G", "trade", 5, "pending"), ("h", "Dataset h", "labor", 10, "pending")]


def test_remove_and_counts(rows, inventory):
    assert values(I.without(inventory, rows("id string", ("a",), ("zz",))), "id") == [("b",), ("c",), ("d",), ("e",)]
    assert values(I.counts(inventory)) == [("domain", "economy", 2), ("domain", "labor", 3), ("status", "completed", 1), ("status", "failed", 1), ("status", "pending", 3)]
    assert I.summary(inventory).first().asDict() == dict(total=5, pending=3, processing=0, completed=1, failed=1)
    assert I.summary(inventory.filter("false")).first().asDict() == dict(total=0, pending=0, processing=0, completed=0, failed=0)


def test_changes_restore_the_new_table(rows):
    old = rows("k int, value double", (1, 1.0), (2, 2.0), (3, None), (4, None), (9, 9.0))
    new = rows("k int, value double", (1, 1.0), (2, 5.0), (3, 7.0), (4, None), (5, None))
    diff = I.changes(new, old, ["k"])
    assert values(diff) == [(2, 5.0, "changed"), (3, 7.0, "changed"), (5, None, "new")]
    kept = old.join(diff.select("k"), "k", "left_anti").join(new.select("k"), "k", "left_semi")
    assert values(kept.unionByName(diff.drop("change"))) == values(new)


def test_missing_chunks_and_throughput(rows):
    plan = rows("dataset_id string, chunk_num int", ("a", 0), ("a", 1), ("b", 0))
    assert values(I.missing_chunks(plan, rows("dataset_id string, chunk_num int", ("a", 1)), ["dataset_id", "chunk_num"])) == [("a", 0), ("b", 0)]
    log = rows("record_count bigint, duration_seconds double", (100, 4.0), (5, 0.0))
    assert values(I.throughput(log), "records_per_second") == [(25.0,), (None,)]


def test_early_stop(rows):
    periods = rows("dataset_id string, year int, records bigint", ("a", 2020, 90), ("a", 2019, 5), ("a", 2018, 5), ("b", 2020, 10))
    got = I.early_stop(periods, rows("dataset_id string, expected bigint", ("a", 100), ("b", 100)))
    assert values(got, "dataset_id", "year") == [("a", 2019), ("a", 2020), ("b", 2020)]


def test_error_types(rows):
    cases = {("Request timeout", "X"): "timeout_error", ("boom", "ReadTimeout"): "timeout_error", ("Network unreachable", "X"): "network_error", ("API said no", "X"): "api_error",
             ("boom", "ApiError"): "api_error", ("Invalid JSON", "X"): "data_error", ("validation of rows", "X"): "validation_error", ("boom", "ValidationError"): "validation_error",
             ("S3 bucket", "X"): "storage_error", ("?", "X"): "unknown_error", (None, None): "unknown_error", ("api connection", "X"): "network_error"}
    df = rows("m string, c string, n int", *((m, c, i) for i, (m, c) in enumerate(cases))).orderBy("n")
    assert [r[0] for r in df.select(E.error_type(F.col("m"), F.col("c"))).collect()] == list(cases.values())
    kinds = rows("k string", *((k,) for k in ("timeout_error", "network_error", "api_error", "storage_error", "data_error", "validation_error", "unknown_error")))
    assert [r[0] for r in kinds.select(E.is_retryable(F.col("k"))).collect()] == [True] * 4 + [False] * 3


def test_changes_against_repeated_old_keys(rows):
    old = rows("k int, value double, v int", (1, 1.0, 1), (1, 2.0, 2), (2, 5.0, 1), (2, 5.0, 2), (3, None, 1), (None, 4.0, 1))
    new = rows("k int, value double", (1, 2.0), (2, 5.0), (3, None), (4, 1.0), (None, 4.0))
    got = lambda **o: sorted((r.k, r.change) for r in I.changes(new, old, ["k"], **o).collect())
    assert got(latest="v") == [(4, "new")]
    assert got() == [(1, "changed"), (4, "new")]
