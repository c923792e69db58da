import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.conftest import values
from tidycell import schemas
from tidycell.operators import inventory as I
from tidycell.plans import ingest as P
from tidycell.schemas import cell_schema
from tidycell.session import scratch
from tidycell.sources import files, tables

NOW = dt.datetime(2024, 1, 1)
GENERIC = "dataset_id string, stats_data_id string, year int, region_code string, category string, value double, unit string, updated_at timestamp"


def batch(spark, *cells, at=NOW):
    return spark.createDataFrame([("D", "S", y, r, c, v, "u", at) for y, r, c, v in cells], GENERIC)


def stored(spark, path, domain="generic"):
    return values(tables.read_domain(spark, path, domain), "year", "region_code", "category", "value")


def test_round_trip_keeps_codes_and_order(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("D", "S", 2020, 1, "01000", "i", 1.5, "u", NOW), ("D", "S", 2020, 1, "", "i", None, "u", NOW)], schemas.schema("economy"))
    tables.append(spark, rows, path, "economy")
    back = tables.read_domain(spark, path, "economy")
    assert back.columns == schemas.column_names("economy")
    assert values(back) == values(rows)
    assert (tmp_path / "t" / "year=2020" / "region_code=01000").is_dir()


def test_load_again_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    first = batch(spark, (2020, "1", "a", 1.0), (2020, "2", "a", 2.0), (2020, "1", "a", 1.0))
    assert tables.load_new(spark, first, path, "generic").loaded == 2
    for again in (first, first.limit(1), batch(spark, (2020, "2", "a", 2.0), at=NOW + dt.timedelta(days=1))):
        assert tables.load_new(spark, again, path, "generic").loaded == 0
    more = batch(spark, (2020, "2", "a", 2.0), (2021, "1", "a", 9.0), (2020, "", "", None))
    assert tables.load_new(spark, more, path, "generic").loaded == 2
    assert stored(spark, path) == sorted([(2020, "1", "a", 1.0), (2020, "2", "a", 2.0), (2021, "1", "a", 9.0), (2020, "", "", None)], key=repr)
    assert tables.load_new(spark, more, path, "generic").loaded == 0


def test_chunks_combined_file_and_chunk_again(spark, tmp_path):
    path = str(tmp_path / "t")
    chunks = [batch(spark, *((2000 + y, str(r), "c", float(y * r)) for y in range(5) for r in part)) for part in (range(5), range(5, 9))]
    for df in (chunks[0], chunks[1], chunks[0].unionByName(chunks[1]), chunks[0]):
        tables.load_new(spark, df, path, "generic")
    assert tables.read_domain(spark, path, "generic").count() == 45


def test_replace_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.replace_partitions(spark, batch(spark, (2020, "1", "a", 1.0), (2021, "1", "a", 2.0)), path, "generic")
    tables.replace_partitions(spark, batch(spark, (2021, "1", "b", 3.0)), path, "generic")
    assert stored(spark, path) == [(2020, "1", "a", 1.0), (2021, "1", "b", 3.0)]


@pytest.mark.parametrize("change", [lambda d: d.drop("unit"), lambda d: d.withColumn("extra", F.lit(1)), lambda d: d.withColumn("year", F.col("year").cast("bigint"))])
def test_wrong_schema_is_refused(spark, tmp_path, change):
    with pytest.raises(ValueError):
        tables.append(spark, change(batch(spark, (2020, "1", "a", 1.0))), str(tmp_path / "t"), "generic")
    assert tables.read_existing(spark, str(tmp_path / "t"), "generic") is None


def test_rebuild_is_all_or_nothing(spark, tmp_path):
    good, wrong = str(tmp_path / "good"), str(tmp_path / "wrong")
    rows = batch(spark, (2020, "01000", "a", 1.0), (2021, "", "b", None))
    rows.write.parquet(good)
    rows.withColumn("year", F.col("year").cast("string")).write.parquet(wrong)
    sources = spark.read.parquet(good).inputFiles()
    assert tables.rebuild(spark, sources, str(tmp_path / "t"), "generic", "rebuilt") == 2
    with pytest.raises(ValueError):
        tables.rebuild(spark, sources + spark.read.parquet(wrong).inputFiles(), str(tmp_path / "t"), "generic", "rebuilt")
    assert spark.table("rebuilt").count() == 2
    assert tables.rebuild(spark, sources, str(tmp_path / "t"), "generic", "rebuilt") == 2
    assert spark.table("rebuilt").count() == 2
    spark.sql("DROP TABLE rebuilt")


def test_conform(spark):
    rows = spark.createDataFrame([("D", "S", 2020, 1, "01000", "i", 1.5, "u", NOW)], schemas.schema("economy"))
    long = tables.conform(rows, schemas.LONG_ECONOMY_COLUMNS)
    assert dict(long.dtypes)["year"] == "bigint" and values(long, "year", "quarter", "indicator") == [(2020, 1, "i")]
    assert tables.conform(rows, schemas.LOAD_TABLE_COLUMNS, {"indicator": "category"}).first().category == "i"
    with pytest.raises(ValueError):
        tables.conform(rows, schemas.LOAD_TABLE_COLUMNS)


def test_small_load_never_shuffles_the_table(spark, tmp_path, monkeypatch):
    path, seen = str(tmp_path / "t"), []
    tables.load_new(spark, batch(spark, *((2000 + y, str(r), "c", 1.0) for y in range(4) for r in range(50))), path, "generic")
    staged = tables.stage(spark, batch(spark, (2001, "1", "c", 1.0), (2001, "x", "c", 1.0)), "small")

    def capture(spark, df, name, write=tables.stage):
        df.collect()
        seen.append(df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])
        return write(spark, df, name)

    monkeypatch.setattr(tables, "stage", capture)
    assert tables.load_new(spark, staged, path, "generic").loaded == 1
    # Shuffled are the batch's own rows and, of the table, those of its cells.
    assert "SortMergeJoin" not in seen[0] and seen[0].count("Exchange hashpartitioning") == 2 and "LeftSemi" in seen[0]
    assert "year#" in seen[0].split("PartitionFilters: [")[-1] or "2001" in seen[0]


def keyed(spark, *rows, dataset="W"):
    """Cells by month, whose key the yearly table does not show."""
    made = batch(spark, *((2020, "1", "a", v) for _, v in rows)) if rows else batch(spark, (2020, "1", "a", 0.0)).limit(0)
    keys = spark.createDataFrame([(i, f"2020{m:02d}") for i, (m, _) in enumerate(rows)], "i int, cell_key string")
    numbered = spark.createDataFrame([(2020, "1", "a", v, i) for i, (_, v) in enumerate(rows)], "y int, r string, c string, v double, i int")
    first = made.limit(1).drop("value")
    return first.crossJoin(numbered.join(keys, "i").select(F.col("v").alias("value"), "cell_key")).select(*schemas.column_names("generic"), "cell_key").withColumn("dataset_id", F.lit(dataset))


def test_monthly_cells_of_a_yearly_table_all_stay(spark, tmp_path):
    path = str(tmp_path / "t")
    months = keyed(spark, *((m, float(m)) for m in range(1, 13)))
    first = tables.load_new(spark, months, path, "generic")
    assert (first.loaded, first.present, first.conflicts) == (12, 0, 0)
    again = tables.load_new(spark, months.unionByName(months), path, "generic")
    assert (again.loaded, again.present, again.copies) == (0, 12, 12)
    assert tables.read_domain(spark, path, "generic").count() == 12


def test_revision_takes_the_place_of_the_old_value_only(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.load_new(spark, keyed(spark, (1, 1.0), (2, 2.0)), path, "generic")
    tables.load_new(spark, keyed(spark, (1, 7.0), dataset="OTHER"), path, "generic")
    load = tables.load_new(spark, keyed(spark, (2, 9.0), (3, 3.0)), path, "generic")
    assert (load.loaded, load.revised, load.present) == (1, 1, 0)
    assert values(tables.read_domain(spark, path, "generic"), "dataset_id", "value") == [("OTHER", 7.0), ("W", 1.0), ("W", 3.0), ("W", 9.0)]
    assert tables.load_new(spark, keyed(spark, (2, 9.0)), path, "generic").present == 1


def test_conflicting_copies_are_handed_back(spark, tmp_path):
    path = str(tmp_path / "t")
    load = tables.load_new(spark, keyed(spark, (1, 1.0), (2, 2.0), (2, 3.0), (3, None), (3, None)), path, "generic")
    assert (load.loaded, load.copies, load.conflicts) == (2, 1, 2)
    assert values(load.conflicting, "value") == [(2.0,), (3.0,)]
    assert values(tables.read_domain(spark, path, "generic"), "value") == [(1.0,), (None,)]


def test_create_and_describe(spark, tmp_path):
    for domain in schemas.DOMAINS:
        name = f"described_{domain}"
        tables.create_domain_table(spark, name, domain, tables.location(str(tmp_path), domain), comments={"value": "the measure"}, properties={"owner_team": "x"})
        found = tables.table_columns(spark, name)
        assert sorted(n for n, _, _ in found) == sorted(schemas.column_names(domain))
        assert {n for n, _, p in found if p} == set(schemas.partition_columns(domain))
        spark.sql(f"DROP TABLE {name}")
    tables.create_inventory_table(spark, "described_inventory", str(tmp_path / "inv"))
    assert len(tables.table_columns(spark, "described_inventory")) == 16
    spark.sql("DROP TABLE described_inventory")


def test_add_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.append(spark, batch(spark, (2020, "1", "a", 1.0)), path, "generic")
    tables.create_domain_table(spark, "evolving", "generic", path)
    spark.sql("ALTER TABLE evolving RECOVER PARTITIONS")
    tables.add_columns(spark, "evolving", [("note", "STRING")])
    assert values(spark.table("evolving"), "category", "note") == [("a", None)]
    spark.sql("DROP TABLE evolving")


def test_codecs(spark, tmp_path):
    df = spark.range(10)
    for codec in files.CODECS:
        files.write_parquet(df, str(tmp_path / codec), codec)
        assert any(codec.replace("gzip", "gz") in f.name for f in (tmp_path / codec).glob("part-*"))
        assert spark.read.parquet(str(tmp_path / codec)).count() == 10
    with pytest.raises(ValueError):
        files.write_parquet(df, str(tmp_path / "x"), "lz9")


def test_file_inventory(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.append(spark, batch(spark, (2020, "1", "a", 1.0), (2021, "1", "a", 1.0), (2021, "2", "a", 1.0)), path, "generic")
    inv = files.file_inventory(tables.read_domain(spark, path, "generic")).collect()
    assert sorted(r.record_count for r in inv) == [1, 2] and all(r.file_size > 0 for r in inv)


def test_metadata_documents(spark, tmp_path):
    docs = spark.createDataFrame([("a", '{"x":1}'), ("b", "{}")], "dataset_id string, metadata_json string")
    tables.save_metadata(docs, str(tmp_path / "m"))
    assert values(tables.load_metadata(spark, str(tmp_path / "m"))) == values(docs)


def test_cells_round_trip(spark, tmp_path):
    cells = spark.createDataFrame([("1", None, "007", None, None, None, None, "01000", "2020", "u", "5")], cell_schema()).withColumn("part", F.lit(3).cast("bigint"))
    files.write_cells(cells, str(tmp_path / "c"), "0007", "part")
    row = files.read_cells(spark, str(tmp_path / "c")).first()
    assert (row.dataset_id, row.chunk, row["@cat01"], row["@area"]) == ("0007", 3, "007", "01000")


def test_ingest_is_complete_and_repeatable(spark, tmp_path):
    cell = lambda t, v, a="01000": ("S", None, "c", None, None, None, None, a, t, "u", v)
    cells = spark.createDataFrame([cell("2020", "1"), cell("2021", "-"), cell("2021", "5"), cell("2021", "5"), cell("2022", "x")], cell_schema())
    for n in range(2):
        report = P.ingest(spark, cells, "weather", "W", str(tmp_path), updated_at=NOW)
        assert (report.rows, report.quarantined, report.loaded, report.valid) == (5, 2, 2 if n == 0 else 0, False)
    assert stored(spark, report.table_path) == [(2020, "01000", "c", 1.0), (2021, "01000", "c", 5.0)]
    assert values(spark.read.parquet(report.quarantine_path), "year", "reasons") == [(2021, ["missing_value"]), (2022, ["missing_value"])]
    other = P.ingest(spark, cells, "weather", "V", str(tmp_path), updated_at=NOW)
    assert other.loaded == 2 and spark.read.parquet(other.quarantine_path).count() == 4
    assert P.ingest(spark, cells.filter("`@time` = '2020'"), "labor", "L", str(tmp_path), updated_at=NOW).as_row(spark).first().valid


def test_batch_goes_on_after_a_failure(spark, tmp_path):
    cell = ("S", None, "c", None, None, None, None, "01000", "2020", "u", "1")
    datasets = spark.createDataFrame(
        [("a", "labor", 5, "pending", 0), ("b", "trade", 9, "pending", 1), ("c", "labor", 1, "pending", 2), ("d", "labor", 10, "completed", 3)],
        "id string, domain string, priority int, status string, added_pos int")

    def cells_of(dataset):
        if dataset == "b":
            raise RuntimeError("Connection refused")
        return spark.createDataFrame([cell], cell_schema())

    out = P.ingest_batch(spark, datasets, cells_of, str(tmp_path), n=5, threshold=2, updated_at=NOW)
    assert values(out, "dataset_id", "status", "error_type") == [("a", "completed", None), ("b", "failed", "network_error")]
    log = spark.read.parquet(str(tmp_path / "logs" / "status"))
    assert values(I.latest(log, "dataset_id", [F.desc("ts")]), "dataset_id", "status") == [("a", "completed"), ("b", "failed")]
    assert log.count() == 4
    loads = I.throughput(spark.read.parquet(str(tmp_path / "logs" / "loads"))).first()
    assert (loads.dataset_id, loads.record_count) == ("a", 1) and loads.storage_bytes > 0 and loads.records_per_second > 0


def test_location():
    assert tables.location("s3://b/", "labor") == "s3://b/iceberg-tables/labor/labor_data/"


def test_scratch_is_below_the_shared_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    a, b = scratch(spark, "x"), scratch(spark, "x")
    assert a != b and a.startswith(base) and b.startswith(base)


def test_rebuild_refuses_a_file_without_a_dimension(spark, tmp_path):
    rows = batch(spark, (2020, "01000", "a", 1.0))
    rows.write.parquet(str(tmp_path / "good"))
    rows.drop("category").write.parquet(str(tmp_path / "bad"))
    sources = [f for n in ("good", "bad") for f in spark.read.parquet(str(tmp_path / n)).inputFiles()]
    with pytest.raises(ValueError, match="category"):
        tables.rebuild(spark, sources, str(tmp_path / "t"), "generic", "rebuilt_lacking")
    assert not spark.catalog.tableExists("rebuilt_lacking")


def test_rebuild_reads_all_files_in_one_scan(spark, tmp_path):
    batch(spark, *((2000 + y, str(r), "c", 1.0) for y in range(4) for r in range(50))).repartition(40).write.parquet(str(tmp_path / "many"))
    sources = spark.read.parquet(str(tmp_path / "many")).inputFiles()
    rows, n = tables._checked_files(spark, sources, "generic")
    assert n == 200 and len(sources) == 40
    assert rows._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_written_bytes_are_those_of_the_load(spark, tmp_path):
    path = str(tmp_path / "t")
    size = lambda: sum(f.stat().st_size for f in (tmp_path / "t").rglob("*.parquet"))
    first = tables.load_new(spark, batch(spark, (2020, "01000", "a", 1.0)), path, "generic")
    assert first.written_bytes == size()
    second = tables.load_new(spark, batch(spark, (2021, "01000", "a", 1.0)), path, "generic")
    assert first.written_bytes + second.written_bytes == size()
    assert tables.load_new(spark, batch(spark, (2021, "01000", "a", 1.0)), path, "generic").written_bytes == 0


def test_documents_are_parsed_where_they_are_held(spark, tmp_path, monkeypatch):
    """Both tables are written from one parse, so no filter makes and parses the documents before they are dealt out."""
    staged, stage = [], tables.stage
    monkeypatch.setattr(tables, "stage", lambda spark, df, name: staged.append(df) or stage(spark, df, name))
    docs = spark.createDataFrame([("a", '{"x": 1}'), ("b", "{"), ("c", None), ("d", "null")], "dataset_id string, metadata_json string")
    bad = tables.save_documents(docs.repartition(3), str(tmp_path / "t"))
    assert sorted(map(tuple, bad.collect())) == [("b", "{"), ("c", None)]
    assert sorted(r.dataset_id for r in tables.load_documents(spark, str(tmp_path / "t")).collect()) == ["a", "d"]
    assert len(staged) == 1 and staged[0]._jdf.queryExecution().optimizedPlan().toString().count("parse_json") <= 1


def test_verdicts_keep_digests_as_bytes(spark):
    """Half the room of their digits; other texts stay what they are, whatever they look like."""
    digest, near = "ab" * 32, ("AB" * 32, "ab" * 32 + "\n", "\u00ab" * 16, "", None)
    want = "stats_data_id string, cell_key string, dataset_id string, value double, updated_at int"
    df = spark.createDataFrame([("s", k, "d", 1.0, 0) for k in (digest, digest, *near)], want)
    present = spark.createDataFrame([("s", k, "d", v, 0) for k, v in ((digest, 2.0), (None, 1.0), ("\u00ab" * 16, 1.0))], want)
    judged = tables.judge(spark, df, present, ["dataset_id", "cell_key"], "packed")
    keys = {bytes(r._cell_key) if r._cell_key is not None else None: r._n for r in judged.keys_of(*tables.STATUSES).collect()}
    assert len(keys) == 6 and keys[b"\0" + bytes.fromhex(digest)] == 2 and keys[None] == 1
    assert {s: judged.counts[s] for s in ("new", "revised", "present")} == {"new": 3, "revised": 1, "present": 2}
    assert values(judged.rows(df, "new"), "cell_key") == [("",), ("AB" * 32,), ("ab" * 32 + "\n",)]


def test_batches_of_loads_are_joined_once(spark, sf, monkeypatch):
    from tidycell.sources import snapshots
    from workloads import sinks

    given = []
    monkeypatch.setattr(snapshots, "load", lambda spark, df, *a: given.append(df))
    monkeypatch.setattr(tables, "load_new", lambda spark, df, *a: given.append(df))
    monkeypatch.setattr(tables, "read_domain", lambda *a: spark.range(1))
    sinks._three_loads(spark, sf, "once")
    sinks.sk12(spark, sf)
    assert len(given) == 7 and all("Join" not in df._jdf.queryExecution().optimizedPlan().toString() for df in given)
