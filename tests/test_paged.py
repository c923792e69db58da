import json
import math

import pytest
from pyspark.sql import functions as F

from tests.conftest import values
from tidycell.sources import files, paged, wire
from tidycell.schemas import cell_schema


def land(spark, root, dataset, total, chunk):
    cells = spark.range(total).select(
        F.lit(dataset).alias("@id"), F.col("id").cast("string").alias("$"), F.floor(F.col("id") / chunk).cast("bigint").alias("part"))
    files.write_cells(cells, root, dataset, "part", mode="append")


def test_every_page_once(spark, tmp_path):
    root = str(tmp_path / "raw")
    land(spark, root, "A", 23, 5)
    land(spark, root, "B", 4, 5)
    pages = paged.pages(spark, root, {"A": 23, "B": 4}, chunk=5)
    assert pages.rdd.getNumPartitions() == 6
    assert values(pages, "dataset_id", "chunk_num", "start_position", "page_limit") == [
        ("A", 0, 1, 5), ("A", 1, 6, 5), ("A", 2, 11, 5), ("A", 3, 16, 5), ("A", 4, 21, 3), ("B", 0, 1, 4)]
    got = values(wire.cells(pages, keep=("dataset_id",)), "dataset_id", F.col("`$`").cast("int"))
    assert got == sorted([("A", i) for i in range(23)] + [("B", i) for i in range(4)], key=repr)


def test_filters_drop_pages_before_the_fetch(spark, tmp_path):
    root = str(tmp_path / "raw")
    land(spark, root, "A", 10, 5)
    pages = paged.pages(spark, root, {"A": 10, "gone": 10}, chunk=5)
    one = pages.filter("dataset_id = 'A' AND chunk_num = 1")
    assert one.rdd.getNumPartitions() == 1 and one.first().start_position == 6
    assert pages.filter("dataset_id = 'nobody'").count() == 0
    assert pages.filter("chunk_num = 7").count() == 0


def test_everything_is_planned_by_default():
    reader = paged.PagedReader({"root": "r", "datasets": "A:3500000", "chunk": "100000"})
    assert len(reader.partitions()) == 35 and reader.partitions()[-1].first == 34


def test_absent_page_fails(tmp_path):
    with pytest.raises(FileNotFoundError):
        paged.landed_page(str(tmp_path), "A", 0, 1, 10)
    with pytest.raises(FileNotFoundError):
        paged.landed_page("hdfs://host/raw", "A", 0, 1, 10)


def test_cap_and_runs_of_pages():
    reader = paged.PagedReader({"root": "r", "datasets": "A:100,B:7,C:0", "chunk": "10", "max_records": "45", "pages_per_task": "2"})
    runs = [(r.dataset_id, r.first, r.last) for r in reader.partitions()]
    assert runs == [("A", 0, 1), ("A", 2, 3), ("A", 4, 4), ("B", 0, 0)]
    reader.fetch = lambda root, d, n, start, limit: f"{start}+{limit}"
    assert [row[4] for run in reader.partitions() for row in reader.read(run)] == ["1+10", "11+10", "21+10", "31+10", "41+5", "1+7"]


def test_url_fetcher_and_envelopes(spark, tmp_path):
    for start in (1, 3):
        rows = [{"@id": "U", "$": str(start + i)} for i in range(2)]
        doc = {"GET_STATS_DATA": {"RESULT": {"STATUS": 0}, "STATISTICAL_DATA": {"DATA_INF": {"VALUE": rows}}}}
        (tmp_path / f"U_{start}.json").write_text(json.dumps(doc))
    pages = paged.pages(spark, f"file://{tmp_path}/{{dataset_id}}_{{start}}.json", {"U": 4}, fetcher="url", chunk=2)
    assert values(wire.cells(pages), "`$`") == [("1",), ("2",), ("3",), ("4",)]


def test_missing_page_fails_loudly(spark, tmp_path):
    pages = paged.pages(spark, f"file://{tmp_path}/none.json", {"U": 1}, fetcher="url")
    with pytest.raises(Exception):
        pages.collect()


@pytest.mark.parametrize("total", [0, 1, 99999, 100000, 100001, 5000000])
def test_chunk_plan(rows, total):
    plan = paged.chunk_plan(rows("dataset_id string, total_records bigint", ("d", total))).orderBy("chunk_num").collect()
    assert len(plan) == math.ceil(total / 100000)
    assert sum(r.chunk_limit for r in plan) == total
    assert [r.start_position for r in plan] == [i * 100000 + 1 for i in range(len(plan))]


CODES = "dataset_id string, category_id string, category_name string, category_pos int, code string, name string, code_pos int"


def test_split_plan(rows):
    codes = rows(CODES, ("a", "cat01", "", 0, "x", "", 0), ("a", "time", "", 1, "t", "", 0), ("a", "area", "", 2, "1", "", 0), ("a", "area", "", 2, "2", "", 1),
                 ("b", "cat01", "", 0, "x", "", 0), ("b", "time", "", 1, "t", "", 0), ("c", "cat02", "", 1, "y", "", 0), ("c", "cat01", "", 0, "x", "", 0))
    assert values(paged.split_plan(codes), "dataset_id", "filter_category", "filter_value") == [("a", "area", "1"), ("a", "area", "2"), ("b", "time", "t"), ("c", "cat01", "x")]


def test_split_plan_without_positions(rows):
    codes = rows("dataset_id string, category_id string, category_pos int, code string, code_pos int",
                 ("a", "x", 0, "1", 0), ("a", "y", None, "2", 0), ("a", "y", 5, "3", 1), (None, "x", 0, "4", 0))
    assert values(paged.split_plan(codes), "dataset_id", "filter_category", "filter_value") == [("a", "y", "2"), ("a", "y", "3")]


def test_plans_broadcast_neither_codes_nor_choices(spark):
    """Both grow with the datasets, whatever the size of the files says."""
    from tests.test_wire import META, docs

    codes = wire.code_list(docs(spark, META).withColumnRenamed("n", "dataset_id"), keep=("dataset_id",))
    for plan in (paged.split_plan(codes), paged.period_plan(codes)):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in text and "SortMergeJoin" in text


def test_period_plan(rows):
    years = lambda d, cat, name, labels, pos: [(d, cat, name, pos, str(i), label, i) for i, label in enumerate(labels)]
    data = (
        years("a", "cat01", "kind", [f"k{i}" for i in range(20)], 0)
        + years("a", "cat03", "survey", [f"{2000 + i}年" for i in range(12)] + ["（概算）_2022年", "total"], 1)
        + years("b", "cat01", "年度", [f"x{i}" for i in range(10)] + ["1999年"], 0)
        + years("c", "cat01", "survey", [f"{2000 + i}年" for i in range(10)], 0)
    )
    got = paged.period_plan(rows(CODES, *data)).orderBy("dataset_id", "fetch_order").collect()
    assert [r.period_year for r in got if r.dataset_id == "a"] == [2022, *range(2011, 1999, -1)]
    assert [(r.category_id, r.period_year) for r in got if r.dataset_id == "b"] == [("cat01", 1999)]
    assert not [r for r in got if r.dataset_id == "c"]  # ten codes are too few to count as time


def test_period_label_forms(rows):
    df = rows("t string", ("2020年",), ("（概算）_2022年",), ("2021年_速報",), ("2020",), ("2020年度",))
    assert [r[0] for r in df.select(paged.label_year(F.col("t"))).collect()] == ["2020", "2022", "2021", "", ""]


def test_cell_schema_width():
    assert len(cell_schema(15)) == 21


def test_a_plan_is_fetched_once_and_failed_pages_again(spark, tmp_path):
    root, path, calls = str(tmp_path / "raw"), str(tmp_path / "landed"), tmp_path / "calls"
    calls.mkdir()
    land(spark, root, "A", 23, 5)
    land(spark, root, "B", 4, 5)
    plan = paged.chunk_plan(spark.createDataFrame([("A", 23), ("B", 4), ("C", 0)], "dataset_id string, total_records bigint"), 5)

    def flaky(root, dataset_id, chunk_num, start, limit):
        name = calls / f"{dataset_id}{chunk_num}"
        name.write_text(name.read_text() + "x" if name.exists() else "x")
        if (dataset_id, chunk_num) == ("A", 2) and name.read_text() == "x":
            raise TimeoutError("no answer")
        return paged.stored_page(root, dataset_id, chunk_num, start, limit)

    missing = paged.land_pages(plan, path, root, flaky)
    assert values(missing, "dataset_id", "chunk_num", "error") == [("A", 2, "TimeoutError: no answer")]
    for _ in range(2):
        assert paged.land_pages(plan, path, root, flaky).count() == 0
    assert {f.name: f.read_text() for f in calls.iterdir()} == {"A0": "x", "A1": "x", "A2": "xx", "A3": "x", "A4": "x", "B0": "x"}
    got = values(wire.cells(paged.landed_pages(spark, path), keep=("dataset_id",)), "dataset_id", F.col("`$`").cast("int"))
    assert got == sorted([("A", i) for i in range(23)] + [("B", i) for i in range(4)], key=repr)


def test_a_page_that_was_never_stored_is_an_error(spark, tmp_path):
    plan = paged.chunk_plan(spark.createDataFrame([("A", 3)], "dataset_id string, total_records bigint"), 5)
    missing = paged.land_pages(plan, str(tmp_path / "landed"), str(tmp_path))
    assert [r.error.split(":")[0] for r in missing.collect()] == ["FileNotFoundError"]
    assert paged.land_pages(plan.limit(0), str(tmp_path / "landed"), str(tmp_path)).count() == 0
