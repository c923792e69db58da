import datetime as dt
import json
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tests.conftest import values
from tests.test_tables import GENERIC, NOW, batch
from tidycell import schemas
from tidycell.sources import snapshots as S
from tidycell.sources import tables


def state(spark, path, version=None):
    return values(S.read(spark, path, "generic", version), "year", "region_code", "category", "value")


def test_snapshots_of_two_loads_and_a_revision(spark, tmp_path):
    path = str(tmp_path / "t")
    assert S.latest(spark, path) == 0 and S.read(spark, path, "generic").count() == 0 and S.history(spark, path).count() == 0
    one = batch(spark, *((2000 + y, str(r), "a", 1.0) for y in range(3) for r in range(4)))
    two = batch(spark, (2001, "1", "b", 5.0), (2009, "x", "a", None), (2000, "0", "a", 1.0))
    load, version = S.load(spark, one, path, "generic")
    assert (load.loaded, version) == (12, 1) and load.written_bytes > 0
    load, version = S.load(spark, two, path, "generic")
    assert (load.loaded, load.present, version) == (2, 1, 2)
    load, version = S.load(spark, batch(spark, (2001, "1", "a", 7.0), (2030, "n", "a", 1.0)), path, "generic")
    assert (load.loaded, load.revised, version) == (1, 1, 3)
    assert S.load(spark, one.where("year != 2001"), path, "generic") == (tables.Load(0, 0, 8, 0, 0), 3)  # nothing to do is no snapshot
    first = sorted(((2000 + y, str(r), "a", 1.0) for y in range(3) for r in range(4)), key=repr)
    second = sorted([*first, (2001, "1", "b", 5.0), (2009, "x", "a", None)], key=repr)
    assert state(spark, path, 1) == first and state(spark, path, 2) == second and state(spark, path, 0) == []
    assert state(spark, path) == sorted([(y, r, c, 7.0 if (y, r, c) == (2001, "1", "a") else v) for y, r, c, v in second] + [(2030, "n", "a", 1.0)], key=repr)
    log = S.history(spark, path).orderBy("version").collect()
    assert [(r.version, r.operation, r.added_rows - r.removed_rows) for r in log] == [(1, "append", 12), (2, "append", 2), (3, "revise", 1)]
    # Only the file with the revised cell was written anew.
    assert log[2].removed_files == 1 and log[2].added_rows == 5
    for v in (1, 2, 3):
        counted = S.partition_summary(spark, path, v).agg(F.sum("record_count")).first()[0]
        assert counted == len(state(spark, path, v))
    there = {os.path.join(d, f).split("/data/")[1] for d, _, names in os.walk(f"{path}/data") for f in names if f.endswith(".parquet")}
    assert {r.file for r in S.manifests(spark, path).where("action = 'add'").collect()} == there
    with pytest.raises(ValueError):
        S.read(spark, path, "generic", 4)


def test_a_load_that_died_is_not_seen_and_its_rerun_loads_everything(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    S.load(spark, batch(spark, (2000, "1", "a", 1.0)), path, "generic")
    rows = batch(spark, (2000, "1", "a", 2.0), (2001, "1", "a", 3.0))

    def die(*a, **b):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(S, "_publish", die)
        with pytest.raises(KeyboardInterrupt):
            S.load(spark, rows, path, "generic")
    assert state(spark, path) == [(2000, "1", "a", 1.0)] and len(S.leftovers(spark, path)) == 1
    load, version = S.load(spark, rows, path, "generic")
    assert (load.loaded, load.revised, version) == (1, 1, 2)
    assert state(spark, path) == [(2000, "1", "a", 2.0), (2001, "1", "a", 3.0)] and len(S.leftovers(spark, path)) == 1


def test_loads_at_once_leave_every_cell_once(spark, tmp_path):
    path = str(tmp_path / "t")
    batches = [batch(spark, *((2000 + y, str(r), "a", 1.0) for y in range(k, k + 3) for r in range(3))) for k in range(4)]
    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(lambda b: S.load(spark, b, path, "generic"), batches))
    assert state(spark, path) == sorted(((2000 + y, str(r), "a", 1.0) for y in range(6) for r in range(3)), key=repr)
    assert sum(d.loaded for d, _ in done) == 18 and sum(d.present for d, _ in done) == 18
    log = S.history(spark, path).orderBy("version").collect()
    assert [r.version for r in log] == [*range(1, len(log) + 1)]


def test_a_version_is_taken_once(spark, tmp_path):
    path = str(tmp_path / "t")
    with ThreadPoolExecutor(8) as pool:
        took = list(pool.map(lambda k: S._publish(spark, path, 1, {"load": str(k)}), range(40)))
    assert sum(took) == 1
    assert json.load(open(f"{path}/log/{1:020d}.json"))["load"] == str(took.index(True))
    assert [n for n in os.listdir(f"{path}/log") if n.startswith(".") and not n.endswith(".crc")] == []


def test_a_load_beside_another_one_is_judged_again_only_if_they_meet(spark, tmp_path, monkeypatch):
    path, judged, inner = str(tmp_path / "t"), [], []
    publish, judge = S._publish, tables.judge

    def first_another(spark, path, version, entry):
        if not inner:
            inner.append(None)
            S.load(spark, inner_rows, path, "generic")
        return publish(spark, path, version, entry)

    monkeypatch.setattr(tables, "judge", lambda *a: judged.append(1) or judge(*a))
    monkeypatch.setattr(S, "_publish", first_another)
    inner_rows = batch(spark, (2001, "1", "a", 1.0))
    assert S.load(spark, batch(spark, (2002, "1", "a", 1.0)), path, "generic")[1] == 2 and len(judged) == 2
    inner.clear(), judged.clear()
    inner_rows = batch(spark, (2001, "1", "b", 4.0))
    load, version = S.load(spark, batch(spark, (2001, "1", "b", 4.0), (2001, "1", "a", 9.0)), path, "generic")
    assert (load.revised, load.present, load.loaded, version) == (1, 1, 0, 4) and len(judged) == 3
    assert state(spark, path) == [(2001, "1", "a", 9.0), (2001, "1", "b", 4.0), (2002, "1", "a", 1.0)]


def test_replace_and_restore(spark, tmp_path):
    path, raw = str(tmp_path / "t"), str(tmp_path / "raw")
    S.load(spark, batch(spark, (2000, "1", "a", 1.0), (2001, "1", "a", 1.0)), path, "generic")
    batch(spark, (2000, "1", "a", 3.0), (2005, "", "b", None)).write.parquet(raw)
    reader = S.read(spark, path, "generic")
    assert S.rebuild(spark, spark.read.parquet(raw).inputFiles(), path, "generic") == 2
    assert reader.count() == 2 and values(reader, "value") == [(1.0,), (1.0,)]  # a running reader keeps its state
    assert state(spark, path) == [(2000, "1", "a", 3.0), (2005, "", "b", None)]
    S.load(spark, batch(spark, (2006, "1", "a", 1.0)), path, "generic")
    assert S.restore(spark, path, "generic", 1) == 4
    assert state(spark, path) == state(spark, path, 1) and len(state(spark, path, 3)) == 3
    wrong = str(tmp_path / "wrong")
    batch(spark, (2000, "1", "a", 3.0)).drop("unit").write.parquet(wrong)
    with pytest.raises(ValueError):
        S.rebuild(spark, spark.read.parquet(wrong).inputFiles(), path, "generic")
    assert S.latest(spark, path) == 4


def test_odd_partitions_and_values(spark, tmp_path):
    path = str(tmp_path / "t")
    cells = [(2000, "a b", "x", 1.0), (2000, "c%2Bd+e", "x", 2.0), (2000, "é/ü=1", "x", 3.0), (None, "", "x", 4.0), (2000, None, "x", 5.0), (2000, "", "y", 9.0)]
    rows = batch(spark, *cells)
    S.load(spark, rows, path, "generic")
    want = sorted(((y, r or "", c, v) for y, r, c, v in cells), key=repr)
    assert state(spark, path) == want
    again = batch(spark, *(c for c in cells if c[1] is not None))
    assert S.load(spark, again, path, "generic")[0].loaded == 0
    assert S.load(spark, again.withColumn("value", F.col("value") + 1), path, "generic")[0].revised == 5
    clash = batch(spark, (2000, "q", "x", 1.0), (2000, "q", "x", 2.0))
    load, _ = S.load(spark, clash, path, "generic")
    assert (load.conflicts, load.loaded, load.conflicting.count()) == (2, 0, 2)
    assert S.load(spark, spark.createDataFrame([], GENERIC), path, "generic")[0] == tables.Load(0, 0, 0, 0, 0)


def test_partitions_with_odd_names(spark, tmp_path):
    path = str(tmp_path / "t")
    regions = ["01000", "a b", "c%2Bd+e", "é/ü=1", "", "x:y#z"]
    rows = spark.createDataFrame([("D", "S", 2020, 1, r, "i", float(k), "u", NOW) for k, r in enumerate(regions)], schemas.schema("economy"))
    S.load(spark, rows, path, "economy")
    assert values(S.read(spark, path, "economy"), "region_code", "value") == sorted(((r, float(k)) for k, r in enumerate(regions)), key=repr)
    assert S.load(spark, rows.withColumn("value", F.col("value") + 1), path, "economy")[0].revised == 6
    assert values(S.read(spark, path, "economy"), "region_code", "value") == sorted(((r, k + 1.0) for k, r in enumerate(regions)), key=repr)
    assert S.partition_summary(spark, path).count() == 6


def test_cells_known_by_their_digest(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = batch(spark, (2000, "1", "a", 1.0), (2000, "1", "a", 2.0)).withColumn("cell_key", F.concat(F.lit("k"), F.col("value").cast("string")))
    assert S.load(spark, rows, path, "generic")[0].loaded == 2
    assert S.load(spark, rows.withColumn("updated_at", F.lit(NOW + dt.timedelta(days=2))), path, "generic")[0].present == 2
    assert S.read(spark, path, "generic").columns == schemas.column_names("generic")


def test_a_small_load_reads_only_its_years(spark, tmp_path):
    path = str(tmp_path / "t")
    S.load(spark, batch(spark, *((2000 + y, "1", "c", 1.0) for y in range(6))), path, "generic")
    span = tables.years(batch(spark, (2003, "1", "c", 1.0)))
    assert len(S.read(spark, path, "generic", span=span).inputFiles()) == 1
