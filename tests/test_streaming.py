import datetime as dt
import json

import pytest

from tests.conftest import values
from tidycell.sources import tables
from tidycell.streaming import landing

NOW = dt.datetime(2024, 1, 1)


def cell(area, value, time="2020"):
    return {"@id": "S", "@cat01": "c", "@area": area, "@time": time, "@unit": "u", "$": value}


def land(folder, name, content):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(json.dumps(content, indent=1))


def pick_up(spark, tmp_path, checkpoint="checkpoint", per_batch=None):
    stream = landing.documents(spark, str(tmp_path / "landed"), files_per_batch=per_batch)
    query = landing.run(stream, str(tmp_path / checkpoint), "generic", "DS", str(tmp_path / "table"), str(tmp_path / "bad"), NOW)
    query.awaitTermination()
    assert query.exception() is None
    return values(tables.read_domain(spark, str(tmp_path / "table"), "generic"), "year", "region_code", "value")


def envelope(rows):
    return {"GET_STATS_DATA": {"RESULT": {"STATUS": 0}, "STATISTICAL_DATA": {"DATA_INF": {"VALUE": rows}}}}


def test_pickup(spark, tmp_path):
    landed = tmp_path / "landed"
    land(landed, "S_chunk_001.json", [cell("1", "1"), cell("2", "-"), "stray"])
    land(landed, "S_chunk_002.json", envelope(cell("3", "3")))
    first = [(2020, "1", 1.0), (2020, "3", 3.0)]
    assert pick_up(spark, tmp_path) == first
    assert pick_up(spark, tmp_path) == first  # nothing new landed
    land(landed, "S_complete.json", envelope([cell("1", "1"), cell("2", "-"), cell("3", "3"), cell("4", "4")]))
    land(landed, "S_error.json", {"GET_STATS_DATA": {"RESULT": {"STATUS": 100}}})
    assert pick_up(spark, tmp_path) == [*first, (2020, "4", 4.0)]
    assert spark.read.parquet(str(tmp_path / "bad")).select("region_code").distinct().count() == 1


def test_one_file_per_batch_and_lost_checkpoint(spark, tmp_path):
    landed = tmp_path / "landed"
    for i in range(3):
        land(landed, f"S_chunk_{i}.json", [cell(str(i), str(i)), cell("same", "7")])
    want = [(2020, "0", 0.0), (2020, "1", 1.0), (2020, "2", 2.0), (2020, "same", 7.0)]
    assert pick_up(spark, tmp_path, per_batch=1) == want
    assert pick_up(spark, tmp_path, checkpoint="another") == want  # everything is delivered again


def test_replayed_batch(spark, tmp_path):
    docs = spark.createDataFrame([(json.dumps([cell("1", "1"), cell("2", "x")]),)], "value string")
    for _ in range(2):
        landing.load_batch(docs, 7, "generic", "DS", str(tmp_path / "table"), str(tmp_path / "bad"), NOW)
    assert tables.read_domain(spark, str(tmp_path / "table"), "generic").count() == 1
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 1


def test_labels_and_rejected_documents(spark, tmp_path):
    docs = spark.createDataFrame(
        [(json.dumps([cell("1", "1")]),), (json.dumps({"GET_STATS_DATA": {"RESULT": {"STATUS": 100, "ERROR_MSG": "quota"}}}),), ('[{"@id": "S"',), ("<html>",)], "value string")
    codes = spark.createDataFrame([("area", "1", "North")], "category_id string, code string, name string")
    landing.load_batch(docs, 1, "population", "DS", str(tmp_path / "table"), str(tmp_path / "bad"), NOW, codes=codes, rejects=str(tmp_path / "rejects"))
    assert values(tables.read_domain(spark, str(tmp_path / "table"), "population"), "region_code", "region_name") == [("1", "North")]
    assert values(spark.read.parquet(str(tmp_path / "rejects")), "reason") == [("damaged rows",), ("status 100: quota",), ("unreadable",)]


def test_a_batch_that_died_before_its_commit_is_not_loaded_again(spark, tmp_path, monkeypatch):
    land(tmp_path / "landed", "S_chunk_001.json", [cell("1", "1")])
    first = pick_up(spark, tmp_path)
    for name in ("0", ".0.crc"):  # as if the query had died between the load and its commit
        (tmp_path / "checkpoint" / "commits" / name).unlink(missing_ok=True)
    loads = []
    real = tables.load_new
    monkeypatch.setattr(tables, "load_new", lambda *a, **k: loads.append(a) or real(*a, **k))
    assert pick_up(spark, tmp_path) == first and not loads
    land(tmp_path / "landed", "S_chunk_002.json", [cell("1", "5"), cell("2", "2")])  # a revision is no repeat
    assert pick_up(spark, tmp_path) == [(2020, "1", 5.0), (2020, "2", 2.0)] and len(loads) == 1


def test_a_batch_that_died_within_its_load_is_loaded_again(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(json.dumps([cell("1", "1"), cell("2", "2")]),)], "value string")
    args = (docs, 3, "generic", "DS", str(tmp_path / "table"), str(tmp_path / "bad"), NOW)
    real = tables.load_new

    def dies(*a, **k):
        real(*a, **k)
        raise RuntimeError("gone")

    monkeypatch.setattr(tables, "load_new", dies)
    with pytest.raises(RuntimeError, match="gone"):
        landing.load_batch(*args, ledger=str(tmp_path / "ledger"))
    monkeypatch.setattr(tables, "load_new", real)
    assert [landing.load_batch(*args, ledger=str(tmp_path / "ledger")) for _ in range(2)] == [True, False]
    assert tables.read_domain(spark, str(tmp_path / "table"), "generic").count() == 2
