"""Readers and fetch plans (SC-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidycell.functions import metadata as M
from tidycell.session import scratch
from tidycell.sources import files, paged, tables, wire
from workloads import scalars, views as V
from workloads.registry import query, view

# --- one document per order: list, lone object, bare list, list with strays, error ---------

def documents(spark, sf):
    priority = F.col("o_orderpriority")
    cell = lambda tab, value: F.struct(
        F.lit("DOC").alias("@id"), F.lit(tab).alias("@tab"), F.col("o_orderstatus").alias("@cat01"),
        F.date_format("o_orderdate", "yyyyMM").alias("@time"), value.alias("$"))
    first, second = cell("1", V.money("o_totalprice")), cell("2", F.col("o_custkey").cast("string"))
    pair = F.to_json(F.array(first, second))
    envelope = lambda rows, total: F.concat(
        F.lit('{"GET_STATS_DATA":{"RESULT":{"STATUS":0},"STATISTICAL_DATA":{"RESULT_INF":{"TOTAL_NUMBER":'), F.lit(str(total)),
        F.lit('},"DATA_INF":{"VALUE":'), rows, F.lit("}}}}"))
    text = (
        F.when(priority == "1-URGENT", envelope(pair, 2))
        .when(priority == "2-HIGH", envelope(F.to_json(first), 1))
        .when(priority == "3-MEDIUM", pair)
        .when(priority == "4-NOT SPECIFIED", envelope(F.concat(F.lit('["note",7,'), F.substring(pair, 2, 1 << 20)), 4))
        .otherwise(F.concat(F.lit('{"GET_STATS_DATA":{"RESULT":{"STATUS":100,"ERROR_MSG":"no data for '), F.col("o_orderkey"), F.lit('"}}}')))
    )
    return V.table(spark, sf, "orders").select("o_orderkey", text.alias("value"))


view("doc_cells", f"""
SELECT o_orderkey, o_orderpriority, 'DOC' AS id, '1' AS tab, o_orderstatus AS cat01, strftime(o_orderdate, '%Y%m') AS period, {V.sql_money('o_totalprice')} AS measure
FROM orders WHERE o_orderpriority <> '5-LOW'
UNION ALL SELECT o_orderkey, o_orderpriority, 'DOC', '2', o_orderstatus, strftime(o_orderdate, '%Y%m'), CAST(o_custkey AS VARCHAR)
FROM orders WHERE o_orderpriority NOT IN ('2-HIGH', '5-LOW')""")


def _named(cells):
    return cells.select("o_orderkey", F.col("`@id`").alias("id"), F.col("`@tab`").alias("tab"), F.col("`@cat01`").alias("cat01"),
                        F.col("`@time`").alias("period"), F.col("`$`").alias("measure"))


def _landed(spark, docs, name):
    """Documents written as text files, one per line, and read back as landed files."""
    path = scratch(spark, name)
    docs.select("value").write.text(path)
    return wire.read_documents(spark, path, whole=False)


@query("sc01_envelope_cells", "SELECT id, tab, cat01, period, measure FROM doc_cells")
def sc01(spark, sf):
    docs = _landed(spark, documents(spark, sf), "sc01")
    return _named(wire.cells(docs.withColumn("o_orderkey", F.lit(0)), keep=("o_orderkey",))).drop("o_orderkey")


@query("sc02_detect_form", """
SELECT CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'list' ELSE 'envelope' END AS form, count(DISTINCT o_orderkey) AS documents, count(measure) AS cells
FROM (SELECT o.o_orderkey, o.o_orderpriority, d.measure FROM orders o LEFT JOIN doc_cells d ON o.o_orderkey = d.o_orderkey) GROUP BY form""")
def sc02(spark, sf):
    env = wire.envelope(documents(spark, sf))
    per_doc = env.select("form", F.coalesce(F.size(F.filter(
        F.from_json("rows_json", "array<string>"), lambda e: e.startswith("{"))), F.lit(0)).alias("n"))
    return per_doc.groupBy("form").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("cells"))


@query("sc03_bare_list", """
SELECT o_orderkey AS k, CAST(o_totalprice AS VARCHAR) AS v, (SELECT count(*) FROM orders) AS record_count FROM orders ORDER BY o_orderkey LIMIT 3""")
def sc03(spark, sf):
    path = scratch(spark, "sc03")
    cell = F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("@id"), F.col("o_totalprice").cast("string").alias("$")))
    # A file holds one list over many lines, of at most a thousand cells.
    lists = V.table(spark, sf, "orders").groupBy(F.floor(F.col("o_orderkey") / 1000).alias("file")).agg(F.collect_list(cell).alias("cells"))
    lists.select("file", F.concat(F.lit("[\n"), F.array_join("cells", ",\n"), F.lit("\n]")).alias("value")).write.partitionBy("file").text(path)
    cells = wire.read_cell_lists(spark, path)
    count = cells.agg(F.count(F.lit(1))).scalar()
    first = cells.select(F.col("`@id`").cast("bigint").alias("k"), F.col("`$`").alias("v")).orderBy("k").limit(3)
    return first.withColumn("record_count", count)


@query("sc04_skip_non_objects", """
SELECT o_orderkey, id, tab, cat01, period, measure, o_orderpriority = '4-NOT SPECIFIED' AS had_strays FROM doc_cells""")
def sc04(spark, sf):
    docs = documents(spark, sf).withColumn("had_strays", F.col("value").contains('["note",7,'))
    cells = wire.cells(docs, keep=("o_orderkey", "had_strays"))
    return _named(cells.withColumn("o_orderkey", F.struct("o_orderkey", "had_strays"))).select(
        "o_orderkey.o_orderkey", "id", "tab", "cat01", "period", "measure", "o_orderkey.had_strays")


@query("sc05_lone_object", """
SELECT o.o_orderkey, o_orderpriority = '2-HIGH' AS was_lone, COALESCE(n, 0) AS cells FROM orders o
LEFT JOIN (SELECT o_orderkey, count(*) + CASE WHEN any_value(o_orderpriority) = '4-NOT SPECIFIED' THEN 2 ELSE 0 END AS n FROM doc_cells GROUP BY o_orderkey) d
  ON o.o_orderkey = d.o_orderkey""")
def sc05(spark, sf):
    env = wire.envelope(documents(spark, sf))
    return env.select("o_orderkey", F.col("value").contains('"VALUE":{').alias("was_lone"),
                      F.coalesce(F.size(F.from_json("rows_json", "array<string>")), F.lit(0)).cast("bigint").alias("cells"))


@query("sc06_code_list", "SELECT * FROM part_classes")
def sc06(spark, sf):
    return wire.code_list(scalars.part_metadata(spark, sf), keep=("dataset_id",))


def _list_documents(spark, sf):
    o = V.table(spark, sf, "customer")
    entry = lambda i, title: F.struct(
        F.concat(F.col("c_custkey").cast("string"), F.lit(i)).alias("@id"), title.alias("TITLE"), F.col("c_mktsegment").alias("STATISTICS_NAME"),
        F.struct(F.lit("00200").alias("@code"), F.col("c_name").alias("$")).alias("GOV_ORG"), F.lit("2020-01-01").alias("OPEN_DATE"))
    objects = F.array(F.to_json(entry("a", F.col("c_name"))), F.to_json(entry("b", F.struct(F.col("c_mktsegment").alias("$"), F.lit("2").alias("@no")))))
    rows = F.when(F.col("c_acctbal") < 0, objects[0]).otherwise(F.concat(F.lit("["), F.array_join(objects, ","), F.lit("]")))
    return o.select("c_custkey", F.concat(F.lit('{"GET_STATS_LIST":{"DATALIST_INF":{"TABLE_INF":'), rows, F.lit("}}}")).alias("value"))


@query("sc07_catalogue", """
SELECT c_custkey, 0 AS position, CAST(c_custkey AS VARCHAR) || 'a' AS id, c_name AS title, c_name AS gov_org, c_mktsegment AS statistics_name, '2020-01-01' AS open_date FROM customer
UNION ALL SELECT c_custkey, 1, CAST(c_custkey AS VARCHAR) || 'b', c_mktsegment, c_name, c_mktsegment, '2020-01-01' FROM customer WHERE c_acctbal >= 0""")
def sc07(spark, sf):
    return wire.catalogue(_list_documents(spark, sf), keep=("c_custkey",)).select(
        "c_custkey", "position", "id", "title", "gov_org", "statistics_name", "open_date")


@query("sc08_parquet_profile", """
SELECT CAST(c.position AS INTEGER) AS position, c.column_name, c.type, n AS non_null, n AS row_count FROM (SELECT count(*) AS n FROM orders),
 (VALUES (0, 'o_orderkey', 'bigint'), (1, 'o_custkey', 'bigint'), (2, 'o_orderstatus', 'string'), (3, 'o_totalprice', 'double'), (4, 'o_orderdate', 'timestamp_ntz'), (5, 'o_orderpriority', 'string')) AS c(position, column_name, type)""")
def sc08(spark, sf):
    return files.parquet_profile(files.read_parquet(spark, f"{sf}/orders.parquet"))


@query("sc08_row_groups", """
SELECT o_orderstatus AS status, count(*) AS rows, TRUE AS split, 'zstd' AS codec, CAST(6 AS INTEGER) AS columns FROM orders GROUP BY o_orderstatus""")
def sc08_groups(spark, sf):
    """Orders written by status, each file with small row groups."""
    path = scratch(spark, "sc08")
    V.table(spark, sf, "orders").withColumn("status", F.col("o_orderstatus")).repartition("status").write.partitionBy("status") \
        .option("parquet.block.size", 16 << 10).option("compression", "zstd").parquet(path)
    found = files.row_groups(spark, path).withColumn("status", F.regexp_extract("file_path", "/status=([^/]*)/", 1))
    return found.groupBy("status").agg(F.sum("rows").alias("rows"), ((F.max("row_group") >= 0) & (F.min("stored_bytes") > 0)).alias("split"), F.max("codec").alias("codec"), F.max("columns").alias("columns"))


@query("sc08_first_rows", """
SELECT CAST(position AS INTEGER) AS position, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders) WHERE position < 5""")
def sc08_first(spark, sf):
    """The head of a file that holds all orders in the order of their keys."""
    path = scratch(spark, "sc08f")
    V.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus").orderBy("o_orderkey").coalesce(1).write.parquet(path)
    row = F.from_json("row", "o_orderkey bigint, o_orderstatus string")
    return files.first_rows(spark, path).select("position", row["o_orderkey"].alias("o_orderkey"), row["o_orderstatus"].alias("o_orderstatus"))


@query("sc09_csv_codes_as_text", 'SELECT "@cat01" AS cat01, "@area" AS area, "@time" AS period, "$" AS measure, count(*) AS n FROM cells_customer GROUP BY ALL')
def sc09(spark, sf):
    path = scratch(spark, "sc09")
    cells = V.cells_customer(spark, sf).select("@cat01", "@area", "@time", "$")
    files.write_csv(cells, path, bom=False)
    back = files.read_csv(spark, path, cells.columns)
    return back.groupBy(F.col("`@cat01`").alias("cat01"), F.col("`@area`").alias("area"), F.col("`@time`").alias("period"), F.col("`$`").alias("measure")).agg(F.count(F.lit(1)).alias("n"))


@query("sc10_exact_files", "SELECT region_code, count(*) AS n, round(sum(value), 2) AS total FROM economy GROUP BY region_code")
def sc10(spark, sf):
    # Two sibling directories; only the files of the first are staged.
    root = scratch(spark, "sc10")
    V.economy(spark, sf).write.parquet(f"{root}/parquet/wanted")
    V.economy(spark, sf).write.parquet(f"{root}/parquet/sibling")
    wanted = spark.read.parquet(f"{root}/parquet/wanted").inputFiles()
    return files.read_parquet(spark, wanted).groupBy("region_code").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


CHUNK = 5000


def landed_chunks(spark, sf, name):
    """The orders cells landed as pages of CHUNK cells; returns the root and the dataset size."""
    root = scratch(spark, name)
    cells = V.cells_sales(spark, sf)
    paged_cells = cells.withColumn("chunk", F.floor(F.col("seq") / CHUNK).cast("bigint")).drop("seq")
    files.write_cells(paged_cells, root, "ORD", "chunk")
    return root, files.read_cells(spark, root).count()


@query("sc11_paged_fetch", f"""
SELECT CAST(seq // {CHUNK} AS INTEGER) AS chunk_num, "@id" AS id, "@area" AS area, "@time" AS period, "$" AS measure FROM cells_sales""")
def sc11(spark, sf):
    root, total = landed_chunks(spark, sf, "sc11")
    fetched = paged.pages(spark, root, {"ORD": total}, chunk=CHUNK)
    return wire.cells(fetched, keep=("chunk_num",)).select(
        "chunk_num", F.col("`@id`").alias("id"), F.col("`@area`").alias("area"), F.col("`@time`").alias("period"), F.col("`$`").alias("measure"))


@query("sc11_pages_of_a_plan", f"""
SELECT CAST(seq // {CHUNK} AS BIGINT) AS chunk_num, "@id" AS id, "@area" AS area, "@time" AS period, "$" AS measure FROM cells_sales""")
def sc11_plan(spark, sf):
    """The first pages land, then the whole plan; the second run fetches the others only."""
    root, total = landed_chunks(spark, sf, "sc11-plan")
    path = scratch(spark, "sc11-landed")
    plan = paged.chunk_plan(spark.createDataFrame([("ORD", total)], "dataset_id string, total_records bigint"), CHUNK)
    paged.land_pages(plan.where("chunk_num % 3 = 0"), path, root)
    paged.land_pages(plan, path, root)
    return wire.cells(paged.landed_pages(spark, path), keep=("chunk_num",)).select(
        "chunk_num", F.col("`@id`").alias("id"), F.col("`@area`").alias("area"), F.col("`@time`").alias("period"), F.col("`$`").alias("measure"))


@query("sc12_chunk_plan", """
SELECT dataset_id, i AS chunk_num, i * 100000 + 1 AS start_position, least(100000, wanted - i * 100000) AS chunk_limit FROM (
  SELECT dataset_id, wanted, unnest(range(CAST(ceil(wanted / 100000.0) AS BIGINT))) AS i FROM (
    SELECT CAST(o_orderkey AS VARCHAR) AS dataset_id, CAST(floor(o_totalprice * 25) AS BIGINT) AS wanted FROM orders) WHERE wanted > 0)""")
def sc12(spark, sf):
    sizes = V.table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("dataset_id"), F.floor(F.col("o_totalprice") * 25).cast("bigint").alias("total_records"))
    return paged.chunk_plan(sizes)


@query("sc13_split_by_dimension", """
SELECT dataset_id, 'time' AS filter_category, code AS filter_value, code_pos FROM part_classes WHERE category_id = 'time'""")
def sc13(spark, sf):
    return paged.split_plan(wire.code_list(scalars.part_metadata(spark, sf), keep=("dataset_id",)))


@query("sc14_split_by_period", """
SELECT dataset_id, 'time' AS category_id, CAST(replace(name, '年', '') AS INTEGER) AS period_year, name AS period_label, 12 - code_pos AS fetch_order
FROM part_classes WHERE category_id = 'time'""")
def sc14(spark, sf):
    return paged.period_plan(wire.code_list(scalars.part_metadata(spark, sf), keep=("dataset_id",)))


@query("sc15_fetch_mode", """
SELECT o_orderkey, CASE WHEN t <= 100000 THEN 'single' ELSE 'chunked' END AS mode, t AS records
FROM (SELECT o_orderkey, CAST(floor(o_totalprice * 25) AS BIGINT) AS t FROM orders)""")
def sc15(spark, sf):
    total = F.floor(F.col("o_totalprice") * 25).cast("bigint")
    return V.table(spark, sf, "orders").select("o_orderkey", M.fetch_mode(total).alias("mode"), M.fetch_records(total).alias("records"))


@query("sc16_rejected_documents", """
SELECT o_orderkey, 100 AS status, 'no data for ' || o_orderkey AS error_message FROM orders WHERE o_orderpriority = '5-LOW'""")
def sc16(spark, sf):
    return wire.envelope(documents(spark, sf)).filter(wire.rejected()).select("o_orderkey", "status", "error_message")


@query("sc16_last_page", """
SELECT o_orderkey, o_orderpriority IN ('2-HIGH', '5-LOW') AS is_last FROM orders""")
def sc16_last(spark, sf):
    return wire.envelope(documents(spark, sf)).select("o_orderkey", wire.last_page(2).alias("is_last"))
