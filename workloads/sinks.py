"""Writers and table loads (SK-*); every query returns what it reads back."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from tidycell import schemas
from tidycell.operators import domains

from tidycell.session import scratch
from tidycell.sources import files, snapshots, tables, wire
from workloads import scalars, views as V
from workloads.registry import query

ECONOMY = "SELECT dataset_id, stats_data_id, year, quarter, region_code, indicator, value, unit FROM economy"


def _name(kind):
    return f"{kind}_{uuid.uuid4().hex[:8]}"


def _forget(spark, name, df):
    """Drop a catalogue entry once its rows are addressed by path."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    return df


@query("sk01_parquet", ECONOMY)
def sk01(spark, sf):
    path = scratch(spark, "sk01")
    files.write_parquet(V.economy(spark, sf), path, partition_by=["year", "region_code"])
    return V.bare(tables.read_domain(spark, path, "economy"))


@query("sk02_codecs", """
SELECT codec, count(*) AS n, round(sum(value), 2) AS total FROM labor, (VALUES ('snappy'), ('gzip'), ('zstd')) AS c(codec) GROUP BY codec""")
def sk02(spark, sf):
    out = None
    for codec in files.CODECS:
        path = scratch(spark, f"sk02-{codec}")
        files.write_parquet(V.labor(spark, sf), path, codec=codec)
        part = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.lit(codec).alias("codec"), "n", "total")
        out = part if out is None else out.unionByName(part)
    return out


@query("sk03_csv", """
SELECT dataset_id, region_code, indicator, COALESCE(CAST(year AS VARCHAR), '') AS year, value IS NULL AS is_null, count(*) AS n FROM economy GROUP BY ALL""")
def sk03(spark, sf):
    path = scratch(spark, "sk03")
    df = V.bare(V.economy(spark, sf))
    files.write_csv(df, path)
    back = files.read_csv(spark, path, df.columns)
    return back.groupBy("dataset_id", "region_code", "indicator", "year", F.col("value").isNull().alias("is_null")).agg(F.count(F.lit(1)).alias("n"))


@query("sk04_code_list_csv", """
SELECT category_id AS "カテゴリID", category_name AS "カテゴリ名", CAST(category_count AS VARCHAR) AS "カテゴリ数", code AS "コード", name AS "名称",
       level AS "レベル", parent_code AS "親コード", unit AS "単位" FROM part_classes""")
def sk04(spark, sf):
    path = scratch(spark, "sk04")
    files.write_code_list_csv(wire.code_list(scalars.part_metadata(spark, sf)), path)
    return files.read_csv(spark, path, list(files.CODE_LIST_HEADER)).na.fill("")


@query("sk05_raw_chunks", """
SELECT 'CUS' AS dataset_id, seq // 500 AS chunk, "@cat01" AS cat01, "@area" AS area, "@time" AS period, "$" AS measure FROM cells_customer""")
def sk05(spark, sf):
    path = scratch(spark, "sk05")
    cells = V.cells_customer(spark, sf).withColumn("part", F.floor(F.col("seq") / 500).cast("bigint")).drop("seq")
    files.write_cells(cells, path, "CUS", "part")
    return files.read_cells(spark, path).select(
        "dataset_id", "chunk", F.col("`@cat01`").alias("cat01"), F.col("`@area`").alias("area"), F.col("`@time`").alias("period"), F.col("`$`").alias("measure"))


@query("sk06_domain_table", "SELECT year, count(*) AS n, count(DISTINCT region_code) AS regions FROM labor GROUP BY year")
def sk06(spark, sf):
    name, path = _name("labor_data"), scratch(spark, "sk06")
    tables.create_domain_table(spark, name, "labor", path, comments={"value": "measure"})
    rows = V.labor(spark, sf).hint("rebalance", "year", "region_code")
    rows.select(*schemas.column_names("labor")).createOrReplaceTempView("labor_rows")
    spark.sql(f"INSERT INTO {name} BY NAME SELECT * FROM labor_rows")
    back = tables.read_domain(spark, path, "labor")
    return _forget(spark, name, back.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("region_code").alias("regions")))


@query("sk07_inventory_table", """
SELECT id AS dataset_id, name AS dataset_name, domain, status AS ingestion_status, domain || '_data' AS table_name, '' AS organization FROM inventory""")
def sk07(spark, sf):
    from tidycell.operators import inventory as I
    name, path = _name("dataset_inventory"), scratch(spark, "sk07")
    tables.create_inventory_table(spark, name, path)
    rows = V.inventory(spark, sf).select(
        F.col("id").alias("dataset_id"), F.col("name").alias("dataset_name"), "domain", F.col("status").alias("ingestion_status"),
        F.lit(V.STAMP).alias("ingestion_timestamp"), F.concat("domain", F.lit("_data")).alias("table_name"))
    I.register(rows, V.STAMP).createOrReplaceTempView("inventory_rows")
    spark.sql(f"INSERT INTO {name} BY NAME SELECT * FROM inventory_rows")
    back = spark.read.schema(schemas.INVENTORY).parquet(path)
    return _forget(spark, name, back.select("dataset_id", "dataset_name", "domain", "ingestion_status", "table_name", "organization"))


@query("sk08_table_schema", """
SELECT c.column_name, c.type, c.is_partition, CASE c.column_name WHEN 'value' THEN v ELSE n END AS non_null FROM (SELECT count(*) AS n, count(value) AS v FROM sales),
 (VALUES ('dataset_id', 'string', FALSE), ('stats_data_id', 'string', FALSE), ('region_code', 'string', FALSE), ('category', 'string', FALSE),
  ('value', 'double', FALSE), ('unit', 'string', FALSE), ('updated_at', 'timestamp', FALSE), ('year', 'int', TRUE)) AS c(column_name, type, is_partition)""")
def sk08(spark, sf):
    name, path = _name("generic_data"), scratch(spark, "sk08")
    tables.append(spark, V.sales(spark, sf).drop("seq"), path, "generic")
    tables.create_domain_table(spark, name, "generic", path)
    columns = spark.createDataFrame(tables.table_columns(spark, name), "column_name string, type string, is_partition boolean")
    counts = files.parquet_profile(tables.read_domain(spark, path, "generic")).select("column_name", "non_null")
    return _forget(spark, name, columns.join(counts, "column_name"))


@query("sk09_append_load", "SELECT year, region_code, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT * FROM population UNION ALL SELECT * FROM population) GROUP BY ALL")
def sk09(spark, sf):
    path = scratch(spark, "sk09")
    # Columns in another order: the load goes by name.
    rows = V.population(spark, sf).select("unit", "value", "year", "dataset_id", "region_name", "category", "stats_data_id", "region_code", "updated_at")
    for _ in range(2):
        tables.append(spark, rows, path, "population")
    return tables.read_domain(spark, path, "population").groupBy("year", "region_code").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("sk09_load_table", "SELECT stats_data_id, year, region_code, category, value, unit FROM (SELECT *, indicator AS category FROM economy)")
def sk09_load_table(spark, sf):
    path = scratch(spark, "sk09l")
    tables.conform(V.economy(spark, sf), schemas.LOAD_TABLE_COLUMNS, {"indicator": "category"}).write.parquet(path)
    return V.bare(spark.read.schema(schemas.struct(schemas.LOAD_TABLE_COLUMNS)).parquet(path))


@query("sk10_plain_parquet_table", "SELECT category, count(*) AS n, count(value) AS filled FROM sales GROUP BY category")
def sk10(spark, sf):
    name, path = _name("generic_data"), scratch(spark, "sk10")
    tables.append(spark, V.sales(spark, sf).drop("seq"), path, "generic")
    tables.create_domain_table(spark, name, "generic", path, properties={"format": "parquet"})
    spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    found = spark.sql(f"SELECT count(*) AS n FROM {name}").first().n
    back = tables.read_domain(spark, path, "generic")
    if found != back.count():
        raise AssertionError("the catalogue table and its files disagree")
    return _forget(spark, name, back.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("filled")))


def _rebuilt(spark, sf, rounds):
    """Source files of three datasets rebuilt into one table, ``rounds`` times."""
    root, name = scratch(spark, "rebuild"), _name("economy_data")
    eco = V.economy(spark, sf)
    for dataset in ("ORDF", "ORDO", "ORDP"):
        eco.filter(F.col("stats_data_id") == dataset).write.parquet(f"{root}/raw/{dataset}")
    sources = [f for d in ("ORDF", "ORDO", "ORDP") for f in spark.read.parquet(f"{root}/raw/{d}").inputFiles()]
    for _ in range(rounds):
        tables.rebuild(spark, sources, f"{root}/table", "economy", name)
    path = spark.sql(f"DESCRIBE FORMATTED {name}").filter("col_name = 'Location'").first().data_type
    return _forget(spark, name, tables.read_domain(spark, path, "economy"))


@query("sk11_rebuild", "SELECT stats_data_id, year, count(*) AS n, round(sum(value), 2) AS total FROM economy GROUP BY ALL")
def sk11(spark, sf):
    return _rebuilt(spark, sf, 1).groupBy("stats_data_id", "year").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("sk11_right_types", "SELECT stats_data_id, CAST(year AS BIGINT) AS year, CAST(quarter AS BIGINT) AS quarter, region_code, indicator, value, unit FROM economy")
def sk11_types(spark, sf):
    path = scratch(spark, "sk11t")
    tables.conform(V.economy(spark, sf), schemas.LONG_ECONOMY_COLUMNS).write.parquet(path)
    return V.bare(spark.read.schema(schemas.struct(schemas.LONG_ECONOMY_COLUMNS)).parquet(path))


@query("sk12_idempotent_load", """
SELECT dataset_id, stats_data_id, year, region_code, category, value + CASE WHEN category = '2-HIGH' THEN 1 ELSE 0 END AS value, unit FROM sales""")
def sk12(spark, sf):
    # The batch is written once: its cells would be joined and digested anew for every step of every load.
    path, rows = scratch(spark, "sk12"), tables.stage(spark, _sales(spark, sf), "sk12-rows")
    tables.load_new(spark, rows, path, "generic")
    tables.load_new(spark, rows.filter("category = '1-URGENT'"), path, "generic")
    revised = rows.filter("category = '2-HIGH'").withColumn("value", F.col("value") + 1)
    tables.load_new(spark, revised, path, "generic")
    tables.load_new(spark, revised, path, "generic")
    return V.bare(tables.read_domain(spark, path, "generic"))


@query("sk12_replace_partitions", "SELECT dataset_id, year, region_code, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT * FROM population UNION ALL SELECT * REPLACE ('CUS2' AS dataset_id) FROM population WHERE year >= 1998) GROUP BY ALL")
def sk12b(spark, sf):
    path = scratch(spark, "sk12b")
    rows = V.population(spark, sf)
    tables.replace_partitions(spark, rows, path, "population")
    tables.replace_partitions(spark, rows.filter("year >= 1998").withColumn("dataset_id", F.lit("CUS2")), path, "population")
    tables.replace_partitions(spark, rows.filter("year >= 1998"), path, "population")
    return tables.read_domain(spark, path, "population").groupBy("dataset_id", "year", "region_code").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("sk13_add_column", """
SELECT generation, count(*) AS n, count(note) AS noted FROM (SELECT 'old' AS generation, NULL AS note FROM population UNION ALL SELECT 'new', category FROM population) GROUP BY generation""")
def sk13(spark, sf):
    path = scratch(spark, "sk13")
    pop = V.population(spark, sf)
    pop.withColumn("generation", F.lit("old")).write.parquet(path)
    pop.withColumns({"generation": F.lit("new"), "note": F.col("category")}).write.mode("append").parquet(path)
    return tables.read_evolved(spark, path).groupBy("generation").agg(F.count(F.lit(1)).alias("n"), F.count("note").alias("noted"))


@query("sk13_alter_table", "SELECT year, count(*) AS n, CAST(0 AS BIGINT) AS noted FROM population GROUP BY year")
def sk13b(spark, sf):
    name, path = _name("population_data"), scratch(spark, "sk13b")
    tables.append(spark, V.population(spark, sf), path, "population")
    tables.create_domain_table(spark, name, "population", path)
    tables.add_columns(spark, name, [("note", "STRING")])
    spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    # Registered queries stay lazy, so the altered table is kept for the read.
    return spark.table(name).groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.count("note").alias("noted"))


@query("sk14_location", """
SELECT domain, 's3://lake/iceberg-tables/' || domain || '/' || domain || '_data/' AS location, count(*) AS datasets FROM inventory GROUP BY ALL""")
def sk14(spark, sf):
    return V.inventory(spark, sf).groupBy("domain", tables.location_column("s3://lake/", F.col("domain")).alias("location")).agg(F.count(F.lit(1)).alias("datasets"))


@query("sk15_file_inventory", """
SELECT year, region_code, count(*) AS record_count, TRUE AS has_size FROM economy GROUP BY ALL""")
def sk15(spark, sf):
    path = scratch(spark, "sk15")
    files.write_parquet(V.economy(spark, sf), path, partition_by=["year", "region_code"])
    inv = files.file_inventory(tables.read_domain(spark, path, "economy"))
    part = lambda key: F.regexp_extract("file_path", f"/{key}=([^/]*)/", 1)
    return inv.groupBy(part("year").cast("int").alias("year"), part("region_code").alias("region_code")).agg(
        F.sum("record_count").alias("record_count"), (F.min("file_size") > 0).alias("has_size"))


def _sales(spark, sf):
    return domains.to_domain(domains.with_identity(V.cells_sales(spark, sf)), "generic", "S1", on_bad="null", updated_at=V.STAMP, keep=("cell_key",))


def _three_loads(spark, sf, name):
    """A table of all sales after two loads that overlap and a revision."""
    path, rows = scratch(spark, name), tables.stage(spark, _sales(spark, sf), f"{name}-rows")
    snapshots.load(spark, rows.filter("category != '1-URGENT'"), path, "generic")
    snapshots.load(spark, rows.filter("category in ('1-URGENT', '5-LOW')"), path, "generic")
    snapshots.load(spark, rows.filter("category = '2-HIGH'").withColumn("value", F.col("value") + 1), path, "generic")
    return path


@query("sk15_snapshots", """
WITH s AS (SELECT 1 AS version, 'append' AS operation, count(*) AS net_rows FROM sales WHERE category != '1-URGENT' UNION ALL
 SELECT 2, 'append', count(*) FROM sales WHERE category = '1-URGENT' UNION ALL SELECT 3, 'revise', 0)
SELECT version, operation, net_rows, CAST(sum(net_rows) OVER (ORDER BY version) AS BIGINT) AS rows_after FROM s""")
def sk15_snapshots(spark, sf):
    path = _three_loads(spark, sf, "sk15s")
    log = snapshots.history(spark, path)
    after = None
    for r in log.select("version").collect():
        one = snapshots.partition_summary(spark, path, r.version).agg(F.lit(r.version).alias("version"), F.sum("record_count").alias("rows_after"))
        after = one if after is None else after.unionByName(one)
    return log.select(F.col("version").cast("int").alias("version"), "operation", (F.col("added_rows") - F.col("removed_rows")).alias("net_rows")).join(after, "version")


@query("sk15_manifests", "SELECT 'year=' || COALESCE(CAST(year AS VARCHAR), '__HIVE_DEFAULT_PARTITION__') AS partition, count(*) AS record_count, TRUE AS has_files FROM sales GROUP BY year")
def sk15_manifests(spark, sf):
    found = snapshots.partition_summary(spark, _three_loads(spark, sf, "sk15m"))
    return found.select("partition", "record_count", ((F.col("files") > 0) & (F.col("file_size") > 0)).alias("has_files"))


@query("sk15_as_of", "SELECT dataset_id, stats_data_id, year, region_code, category, value, unit FROM sales WHERE category != '1-URGENT'")
def sk15_as_of(spark, sf):
    return V.bare(snapshots.read(spark, _three_loads(spark, sf, "sk15v"), "generic", 1))


@query("sk12_loads_at_once", "SELECT dataset_id, stats_data_id, year, region_code, category, value, unit FROM sales")
def sk12_loads_at_once(spark, sf):
    """Three loads that overlap run at once, beside the files of one that died."""
    # Written before: threads of one program must not plan expressions that they share.
    path, rows = scratch(spark, "sk12c"), tables.stage(spark, _sales(spark, sf), "sk12c-rows")
    snapshots._write(spark, rows, path, uuid.uuid4().hex, "generic", None)
    batches = [rows.filter("category != '1-URGENT'"), rows.filter("category in ('1-URGENT', '5-LOW')"), rows.filter("category != '2-HIGH'")]
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda b: snapshots.load(spark, b, path, "generic"), batches))
    return V.bare(snapshots.read(spark, path, "generic"))


@query("sk11_swap", "SELECT state, stats_data_id, count(*) AS n FROM (SELECT 'old' AS state, * FROM economy WHERE stats_data_id = 'ORDF' UNION ALL SELECT 'new', * FROM economy) GROUP BY ALL")
def sk11_swap(spark, sf):
    """A table rebuilt from files in one commit; the state before stays readable."""
    path, eco = scratch(spark, "sk11s"), V.economy(spark, sf)
    old = snapshots.replace(spark, eco.filter("stats_data_id = 'ORDF'"), path, "economy")
    eco.write.parquet(f"{path}-raw")
    new = snapshots.rebuild(spark, spark.read.parquet(f"{path}-raw").inputFiles(), path, "economy")
    both = snapshots.read(spark, path, "economy", old).withColumn("state", F.lit("old")).unionByName(snapshots.read(spark, path, "economy", new).withColumn("state", F.lit("new")))
    return both.groupBy("state", "stats_data_id").agg(F.count("*").alias("n"))


@query("sk16_replace_load", "SELECT stats_data_id, count(*) AS n, count(value) AS filled FROM economy GROUP BY ALL")
def sk16(spark, sf):
    return _rebuilt(spark, sf, 2).groupBy("stats_data_id").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("filled"))


@query("sk17_metadata_documents", """
SELECT lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS dataset_id, p_name AS title, p_type AS stat_name FROM part""")
def sk17(spark, sf):
    path = scratch(spark, "sk17")
    tables.save_metadata(scalars.part_metadata(spark, sf).withColumnRenamed("value", "metadata_json"), path)
    back = tables.load_metadata(spark, path)
    return wire.table_info(back, "metadata_json", keep=("dataset_id",)).select("dataset_id", F.col("TITLE").alias("title"), F.col("STAT_NAME").alias("stat_name"))


@query("sk17_typed_documents", """
SELECT lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS dataset_id, CASE WHEN p_size % 7 <> 0 THEN p_name END AS title,
       CASE WHEN p_size % 7 <> 0 AND p_size > 40 THEN 250000::BIGINT END AS records, p_size % 7 = 0 AS rejected FROM part""")
def sk17_typed(spark, sf):
    """Documents kept as typed values; some are cut off and set aside."""
    path = scratch(spark, "sk17t")
    docs = scalars.part_metadata(spark, sf).select("dataset_id", F.when(F.col("p_size") % 7 == 0, F.substring("value", 1, 200)).otherwise(F.col("value")).alias("metadata_json"))
    bad = tables.save_documents(docs, path)
    info = "$.GET_META_INFO.METADATA_INF.TABLE_INF"
    good = tables.load_documents(spark, path, {"title": (f"{info}.TITLE['$']", "string"), "records": (f"{info}.OVERALL_TOTAL_NUMBER", "bigint")})
    none = bad.select("dataset_id", F.lit(None).cast("string").alias("title"), F.lit(None).cast("bigint").alias("records"), F.lit(True).alias("rejected"))
    return good.withColumn("rejected", F.lit(False)).unionByName(none)
