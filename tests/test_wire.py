import json
import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import values
from tidycell.sources import files, wire

ONE = {"@id": "0001", "@time": "2020", "$": "5"}
TWO = {"@id": "0001", "@time": "2021", "$": 6}


def envelope(value, **more):
    return {"GET_STATS_DATA": {"RESULT": {"STATUS": 0}, "STATISTICAL_DATA": {"RESULT_INF": {"TOTAL_NUMBER": 2}, "DATA_INF": {"VALUE": value}}, **more}}


def docs(spark, *documents):
    return spark.createDataFrame([(i, d if isinstance(d, str) else json.dumps(d, ensure_ascii=False)) for i, d in enumerate(documents)], "n int, value string")


def cells(df):
    return values(wire.cells(df, keep=("n",)), "n", "pos", "`@time`", "`$`")


def test_envelope_with_list(spark):
    assert cells(docs(spark, envelope([ONE, TWO]))) == [(0, 0, "2020", "5"), (0, 1, "2021", "6")]


def test_envelope_with_lone_object(spark):
    assert cells(docs(spark, envelope(ONE))) == [(0, 0, "2020", "5")]


def test_bare_list_and_leading_blanks(spark):
    assert cells(docs(spark, [ONE], "  \n " + json.dumps([TWO]))) == [(0, 0, "2020", "5"), (1, 0, "2021", "6")]


def test_strays_are_skipped(spark):
    assert cells(docs(spark, envelope(["x", ONE, 7, None, [1], TWO]))) == [(0, 0, "2020", "5"), (0, 1, "2021", "6")]


@pytest.mark.parametrize("empty", [[], envelope([]), {"GET_STATS_DATA": {}}, {"other": 1}, "not json", envelope(None)])
def test_nothing_to_read(spark, empty):
    assert cells(docs(spark, empty)) == []


def test_rejected(spark):
    bad = {"GET_STATS_DATA": {"RESULT": {"STATUS": 100, "ERROR_MSG": "no such table"}}}
    nodata = {"GET_STATS_DATA": {"RESULT": {"STATUS": 0}}}
    df = wire.envelope(docs(spark, envelope([ONE]), bad, nodata, [ONE], "garbage", '[{"@id": "1"}, {"@i', []))
    assert values(df.filter(wire.rejected()), "n", "form", "status", "error_message") == [
        (1, "envelope", 100, "no such table"), (2, "envelope", 0, None), (4, "unreadable", None, None), (5, "list", None, None)]


def test_error_envelope_with_rows_is_rejected_too(spark):
    doc = envelope([ONE])
    doc["GET_STATS_DATA"]["RESULT"]["STATUS"] = 1
    assert cells(docs(spark, doc)) == []


def test_last_page(spark):
    df = wire.envelope(docs(spark, [ONE, TWO], [ONE], []))
    assert [r[0] for r in df.orderBy("n").select(wire.last_page(2)).collect()] == [False, True, True]


def test_pretty_printed_file(spark, tmp_path):
    (tmp_path / "0004_chunk_001.json").write_text(json.dumps(envelope([ONE, TWO]), indent=2))
    df = wire.read_documents(spark, str(tmp_path))
    assert df.first().path.endswith("0004_chunk_001.json")
    assert values(wire.cells(df), "`@time`") == [("2020",), ("2021",)]


def test_bare_list_file(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([ONE, TWO], indent=1))
    assert wire.read_cell_lists(spark, str(tmp_path)).count() == 2


META = {"GET_META_INFO": {"METADATA_INF": {
    "TABLE_INF": {"@id": "0009", "STAT_NAME": {"@code": "00200", "$": "Census"}, "TITLE": "plain title", "MAIN_CATEGORY": "Pop",
                  "SUB_CATEGORY": {"@code": "01", "$": "Sub"}, "STATISTICS_NAME_SPEC": {"TABULATION_CATEGORY": "T", "TABULATION_SUB_CATEGORY1": "S1"}},
    "CLASS_INF": {"CLASS_OBJ": [
        {"@id": "tab", "@name": "Item", "CLASS": {"@code": "1", "@name": "Total"}},
        {"@id": "area", "@name": "Area", "CLASS": [{"@code": "00000", "@name": "All", "@level": "1"}, {"@code": "01000", "@name": "Hokkaido", "@level": "2", "@parentCode": "00000", "@unit": "u"}]},
        {"@id": "empty", "@name": "Empty"}]}}}}


def test_code_list(spark):
    got = values(wire.code_list(docs(spark, META)), "category_id", "category_count", "code", "name", "level", "parent_code", "unit")
    assert got == [("area", 2, "00000", "All", "1", "", ""), ("area", 2, "01000", "Hokkaido", "2", "00000", "u"), ("tab", 1, "1", "Total", "", "", "")]


def test_lone_class_object(spark):
    lone = {"GET_META_INFO": {"METADATA_INF": {"CLASS_INF": {"CLASS_OBJ": {"@id": "x", "@name": "X", "CLASS": [{"@code": "1", "@name": "a"}]}}}}}
    assert values(wire.code_list(docs(spark, lone)), "category_id", "code") == [("x", "1")]


def test_category_sizes(spark):
    got = values(wire.category_sizes(docs(spark, META, {"a": 1}), keep=("n",)))
    assert got == [(0, [1, 2, 0]), (1, [])]


def test_table_info(spark):
    row = wire.table_info(docs(spark, META)).first()
    assert (row.datasetId, row.statsCode, row.STAT_NAME, row.TITLE, row.MAIN_CATEGORY, row.SUB_CATEGORY) == ("0009", "00200", "Census", "N/A", "Pop", "Sub")
    assert (row.TABULATION_SUB_CATEGORY1, row.TABULATION_SUB_CATEGORY2, row.limit, row.CYCLE) == ("S1", "N/A", "N/A", "N/A")
    assert len(row) == 24


def test_catalogue(spark):
    entry = {"@id": "1", "TITLE": {"@no": "1", "$": "Obj"}, "GOV_ORG": "Org", "OPEN_DATE": "2020-01-01"}
    wrap = lambda t: {"GET_STATS_LIST": {"DATALIST_INF": {"TABLE_INF": t}}}
    df = wire.catalogue(docs(spark, wrap(entry), wrap([entry, {"@id": "2", "TITLE": "Str"}]), wrap([])), keep=("n",))
    assert values(df, "n", "position", "id", "title", "gov_org", "open_date") == [
        (0, 0, "1", "Obj", "Org", "2020-01-01"), (1, 0, "1", "Obj", "Org", "2020-01-01"), (1, 1, "2", "Str", "", "")]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("01000", 'say "hi", now', "a\nb"), ("00001", None, "x")], "code string, t string, u string")
    files.write_csv(df, str(tmp_path / "c"))
    part = next((tmp_path / "c").glob("part-*.csv")).read_bytes()
    assert part.startswith("﻿code".encode())
    assert values(files.read_csv(spark, str(tmp_path / "c"), df.columns)) == values(df)


def test_parquet_profile(spark, tmp_path):
    spark.createDataFrame([(1, None), (2, "x")], "a int, b string").write.parquet(str(tmp_path / "p"))
    got = values(files.parquet_profile(files.read_parquet(spark, str(tmp_path / "p"))))
    assert got == [(0, "a", "int", 2, 2), (1, "b", "string", 1, 2)]


def test_metadata_is_parsed_once(spark):
    """Each text of a document goes through one parser, and no code carries the list of its category."""
    plan = wire.code_list(docs(spark, META), keep=("n",))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 3
    assert re.search(r"Generate posexplode\(members#\d+\), \[\d+\], true", plan)
    sizes = wire.category_sizes(docs(spark, META), keep=("n",))._jdf.queryExecution().optimizedPlan().toString()
    assert sizes.count("METADATA_INF.CLASS_INF.CLASS_OBJ") == 1


def test_odd_class_lists(spark):
    inf = lambda c: {"GET_META_INFO": {"METADATA_INF": {"CLASS_INF": {"CLASS_OBJ": c}}}}
    odd = docs(spark, inf([]), inf("text"), inf([{"@id": "x", "CLASS": []}, {"@id": "y", "CLASS": [{}, {"@code": "1"}]}, {"@id": "z", "CLASS": "no"}]), "no json", {"a": 1})
    assert values(wire.code_list(odd, keep=("n",)), "n", "category_pos", "code_pos", "category_count", "code") == [(2, 1, 0, 2, ""), (2, 1, 1, 2, "1")]


def test_documents_are_made_in_many_tasks(spark):
    from workloads import views as V

    dealt = V.spread(spark.range(0, 95, 1, 1), rows=10)
    assert dealt.rdd.getNumPartitions() == 10 and dealt.count() == 95
    assert max(dealt.rdd.glom().map(len).collect()) <= 12
    assert V.spread(spark.range(0)).count() == 0
