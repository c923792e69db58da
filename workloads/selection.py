"""Filters, windows, ordering (FL-*, WN-*, SL-*, SO-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidycell import schemas
from tidycell.operators import aggregates as A
from tidycell.operators import filters as X
from tidycell.operators import inventory as I
from tidycell.operators import joins as J
from tidycell.operators import quality as Q
from tidycell.operators import search as R
from tidycell.session import scratch
from tidycell.sources import tables, wire
from workloads import scalars, scans, views as V
from workloads.registry import query, view

SALES = "SELECT seq, stats_data_id, year, region_code, category, value FROM sales"


def _sales(spark, sf):
    return V.sales(spark, sf).select("seq", "stats_data_id", "year", "region_code", "category", "value")


@query("fl01_dimension_equality", """
SELECT seq, "@time" AS period, "$" AS measure FROM cells_orders WHERE "@area" = '01000' AND "@cat01" = '1-URGENT' AND "@cat02" = 'F'""")
def fl01(spark, sf):
    kept = V.cells_orders(spark, sf).filter(X.all_equal({"@area": "01000", "@cat01": "1-URGENT", "@cat02": "F"}))
    return kept.select("seq", F.col("`@time`").alias("period"), F.col("`$`").alias("measure"))


_REQUESTS = f"""
SELECT c_custkey AS request_id, CASE WHEN c_mktsegment = 'FURNITURE' THEN 'zone' ELSE 'area' END AS category_id,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'NATION_' || c_nationkey WHEN 'AUTOMOBILE' THEN {V.sql_area('c_nationkey')}
            WHEN 'MACHINERY' THEN substr({V.sql_area('c_nationkey')}, 2, 3) WHEN 'FURNITURE' THEN 'any' ELSE 'X' || c_custkey END AS wanted
FROM customer"""
view("requests", _REQUESTS)


def _requests(spark, sf):
    s, code = F.col("c_mktsegment"), V.area("c_nationkey")
    return V.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("request_id"), F.when(s == "FURNITURE", "zone").otherwise("area").alias("category_id"),
        F.when(s == "BUILDING", F.concat(F.lit("NATION_"), "c_nationkey")).when(s == "AUTOMOBILE", code)
        .when(s == "MACHINERY", F.substring(code, 2, 3)).when(s == "FURNITURE", "any").otherwise(F.concat(F.lit("X"), "c_custkey")).alias("wanted"))


_RESOLVED = """
SELECT request_id, category_id, wanted, code, match FROM (
  SELECT r.request_id, r.category_id, r.wanted, c.code,
         CASE WHEN c.name = r.wanted THEN 'label' WHEN c.code = r.wanted THEN 'code' WHEN c.code IS NOT NULL THEN 'partial' END AS match,
         row_number() OVER (PARTITION BY r.request_id ORDER BY CASE WHEN c.name = r.wanted THEN 0 WHEN c.code = r.wanted THEN 1 ELSE 2 END, c.code_pos) AS rn
  FROM requests r LEFT JOIN classes c ON r.category_id = c.category_id AND (c.name = r.wanted OR contains(c.code, r.wanted))) WHERE rn = 1"""


@query("fl02_resolve_values", _RESOLVED)
def fl02(spark, sf):
    return X.resolve(_requests(spark, sf), V.classes(spark, sf)).select("request_id", "category_id", "wanted", "code", "match")


@query("fl03_unknown_categories", "SELECT request_id, category_id FROM requests WHERE category_id NOT IN (SELECT category_id FROM classes)")
def fl03(spark, sf):
    return X.unknown_categories(_requests(spark, sf), V.classes(spark, sf)).select("request_id", "category_id")


@query("fl02_options", """
SELECT dataset_id, code FROM (SELECT dataset_id, code, row_number() OVER (PARTITION BY dataset_id ORDER BY code_pos) AS rn FROM part_classes WHERE category_id = 'cat01') WHERE rn <= 20""")
def fl02_options(spark, sf):
    codes = wire.code_list(scalars.part_metadata(spark, sf), keep=("dataset_id",)).filter("category_id = 'cat01'")
    return X.options(codes.withColumn("category_id", F.col("dataset_id"))).select("dataset_id", "code")


@query("fl04_selectivity", """
SELECT count(*) FILTER (WHERE "@cat02" = 'F') AS fetched, count(*) AS available, 100 * (count(*) FILTER (WHERE "@cat02" = 'F') / count(*)) AS percent,
       count(*) FILTER (WHERE "@cat02" = 'F') = 0 AS is_empty FROM cells_orders""")
def fl04(spark, sf):
    return X.selectivity(V.cells_orders(spark, sf), X.all_equal({"@cat02": "F"}))


@query("fl05_non_null", SALES + " WHERE value IS NOT NULL")
def fl05(spark, sf):
    return _sales(spark, sf).filter(X.non_null("value"))


@query("fl06_non_empty", """SELECT seq, "$" AS measure FROM cells_sales WHERE "$" IS NOT NULL AND "$" <> ''""")
def fl06(spark, sf):
    return V.cells_sales(spark, sf).filter(X.non_empty("$")).select("seq", F.col("`$`").alias("measure"))


@query("fl07_range_and_equality", SALES + " WHERE year >= 1998 AND region_code = '01000'")
def fl07(spark, sf):
    return _sales(spark, sf).filter((F.col("year") >= 1998) & (F.col("region_code") == "01000"))


def _stored(spark, sf, domain, df, name):
    path = scratch(spark, name)
    tables.append(spark, df, path, domain)
    return tables.read_domain(spark, path, domain)


@query("fl08_partition_filter", "SELECT indicator, quarter, value FROM economy WHERE year = 1998 AND region_code = '01000'")
def fl08(spark, sf):
    stored = _stored(spark, sf, "economy", V.economy(spark, sf), "fl08")
    return stored.filter("year = 1998 AND region_code = '01000'").select("indicator", "quarter", "value")


@query("fl09_columns_and_predicate", "SELECT year, region_code, value FROM economy WHERE year = 1998")
def fl09(spark, sf):
    stored = _stored(spark, sf, "economy", V.economy(spark, sf), "fl09")
    return stored.select("year", "region_code", "value").filter("year = 1998")


@query("fl10_cross_tab_cell", """
SELECT "@area" AS area, "$" AS measure FROM cells_orders WHERE "@cat01" = '2-HIGH' AND "@cat02" = 'O' AND "@cat03" = 'BUILDING' AND "@time" = '1997Q3'""")
def fl10(spark, sf):
    cell = X.all_equal({"@cat01": "2-HIGH", "@cat02": "O", "@cat03": "BUILDING", "@time": "1997Q3"})
    return V.cells_orders(spark, sf).filter(cell).select(F.col("`@area`").alias("area"), F.col("`$`").alias("measure"))


@query("fl11_selected_ids", SALES + " WHERE seq IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45)")
def fl11(spark, sf):
    ids = V.table(spark, sf, "lineitem").filter("l_returnflag = 'R' AND l_quantity >= 45").select(F.col("l_orderkey").alias("seq"))
    return X.selected(_sales(spark, sf), ids, "seq")


@query("fl11_selected_partitions", """
SELECT o_custkey % 40 AS part_id, o_orderstatus, count(*) AS n, max(o_totalprice) AS top FROM orders
WHERE o_custkey % 40 IN (SELECT c_custkey % 40 FROM customer WHERE c_acctbal > 9900) GROUP BY ALL""")
def fl11_partitions(spark, sf):
    """Orders in 40 folders; those of the selected ids are read."""
    path = scratch(spark, "fl11")
    orders = V.table(spark, sf, "orders").withColumn("part_id", F.col("o_custkey") % 40)
    tables.write_by(orders, path, "part_id")
    ids = V.table(spark, sf, "customer").filter("c_acctbal > 9900").select((F.col("c_custkey") % 40).alias("part_id"))
    rows = X.selected(spark.read.schema(orders.schema).parquet(path), ids, "part_id")
    return rows.groupBy("part_id", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top"))


@query("fl12_updated_since", """
SELECT d.dataset_id, d.updated_at FROM (SELECT o_custkey AS dataset_id, max(o_orderdate) AS updated_at FROM orders GROUP BY 1) d
LEFT JOIN (SELECT o_custkey AS dataset_id, max(o_orderdate) AS last_ingested_at FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) i ON d.dataset_id = i.dataset_id
WHERE i.last_ingested_at IS NULL OR d.updated_at > i.last_ingested_at""")
def fl12(spark, sf):
    o = V.table(spark, sf, "orders").withColumnRenamed("o_custkey", "dataset_id")
    datasets = o.groupBy("dataset_id").agg(F.max("o_orderdate").alias("updated_at"))
    ingested = o.filter("o_orderstatus = 'F'").groupBy("dataset_id").agg(F.max("o_orderdate").alias("last_ingested_at"))
    return X.updated_since(datasets, ingested).select("dataset_id", "updated_at")


_CUSTOM = "SELECT region_code, count(*) AS n, max(value) AS top FROM {t} WHERE year BETWEEN 1996 AND 1999 GROUP BY region_code HAVING count(*) > 1"


@query("fl13_custom_sql", _CUSTOM.replace("{t}", "sales"))
def fl13(spark, sf):
    return X.custom_sql(spark, _CUSTOM.replace("{t}", "custom_sales"), {"custom_sales": V.sales(spark, sf)})


# --- windows -------------------------------------------------------------------------------

@query("wn01_first_per_key", """
SELECT "@id" AS id, "@cat01" AS cat01, "@cat02" AS cat02, "@area" AS area, "@time" AS period, "$" AS measure, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY "@id", "@cat01", "@cat02", "@area", "@time", "@unit" ORDER BY seq) AS rn FROM cells_orders) WHERE rn = 1""")
def wn01(spark, sf):
    first = Q.first_per_key(V.cells_orders(spark, sf), ["@id", "@cat01", "@cat02", "@area", "@time", "@unit"], ["seq"])
    names = ("id", "cat01", "cat02", "area")
    return first.select(*(F.col(f"`@{n}`").alias(n) for n in names), F.col("`@time`").alias("period"), F.col("`$`").alias("measure"), "seq")


@query("wn02_rank_per_query", """
SELECT query_id, seq, CAST(rank AS INTEGER) AS rank FROM (SELECT l_suppkey AS query_id, l_orderkey * 100 + l_linenumber AS seq, l_extendedprice,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey * 100 + l_linenumber) AS rank FROM lineitem) WHERE rank <= 5""")
def wn02(spark, sf):
    scored = V.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("query_id"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("position"), F.col("l_extendedprice").alias("score"))
    return R.top_per_query(scored, 5, "score").select("query_id", F.col("position").alias("seq"), "rank")


@query("wn03_current_status", """
SELECT dataset_id, status, event_id FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY ts DESC, event_id DESC) AS rn FROM status_log) WHERE rn = 1""")
def wn03(spark, sf):
    return I.latest(V.status_log(spark, sf), "dataset_id", [F.desc("ts"), F.desc("event_id")]).select("dataset_id", "status", "event_id")


@query("wn04_status_transitions", """
SELECT event_id, dataset_id, lag(status) OVER (PARTITION BY dataset_id ORDER BY ts, event_id) AS from_status, status FROM status_log""")
def wn04(spark, sf):
    return I.transitions(V.status_log(spark, sf), "dataset_id", "ts", "event_id", span="day").select("event_id", "dataset_id", "from_status", "status")


@query("wn05_best_match", f"SELECT match, code, count(*) AS n FROM ({_RESOLVED}) GROUP BY ALL")
def wn05(spark, sf):
    return X.resolve(_requests(spark, sf), V.classes(spark, sf)).groupBy("match", "code").agg(F.count(F.lit(1)).alias("n"))


# --- order, limit, set operations ----------------------------------------------------------

@query("sl01_order_and_limit", "SELECT year, region_code, value, seq FROM sales ORDER BY year DESC NULLS LAST, value DESC NULLS LAST, seq LIMIT 100")
def sl01(spark, sf):
    return A.top(V.sales(spark, sf).select("year", "region_code", "value", "seq"), 100, F.desc_nulls_last("year"), F.desc_nulls_last("value"), F.asc("seq"))


@query("sl02_limit_sample", "SELECT count(*) AS n FROM (SELECT * FROM sales LIMIT 1000)")
def sl02(spark, sf):
    return V.sales(spark, sf).limit(1000).agg(F.count(F.lit(1)).alias("n"))


@query("sl03_newest_periods", 'SELECT "@time" AS period, count(*) AS n FROM cells_lineitem GROUP BY 1 ORDER BY 1 DESC')
def sl03(spark, sf):
    return V.cells_lineitem(spark, sf).groupBy(F.col("`@time`").alias("period")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("period"))


@query("sl04_first_rows", 'SELECT seq, "@area" AS area, "$" AS measure FROM cells_orders ORDER BY seq LIMIT 5')
def sl04(spark, sf):
    return A.top(V.cells_orders(spark, sf), 5, F.asc("seq")).select("seq", F.col("`@area`").alias("area"), F.col("`$`").alias("measure"))


@query("sl05_top_areas", "SELECT region_code, round(fsum(value), 4) AS total_value FROM population GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", fine=True)
def sl05(spark, sf):
    totals = J.series(V.population(spark, sf), "total_value", ["region_code"])
    return A.top(totals, 10, F.desc("total_value"), F.asc("region_code"))


@query("so01_concatenate_chunks", """
SELECT seq, 0 AS chunk_num FROM cells_orders WHERE "@cat02" = 'F' UNION ALL SELECT seq, 1 FROM cells_orders WHERE "@cat02" = 'O'
UNION ALL SELECT seq, 2 FROM cells_orders WHERE "@cat02" = 'P'""")
def so01(spark, sf):
    cells = V.cells_orders(spark, sf)
    return J.concatenate([cells.filter(X.all_equal({"@cat02": s})).select("seq") for s in ("F", "O", "P")])


@query("so02_union_datasets", """
SELECT stats_data_id, year, count(*) AS n FROM (SELECT stats_data_id, year FROM sales UNION ALL SELECT stats_data_id, year FROM population) GROUP BY ALL""")
def so02(spark, sf):
    cols = [c for c in schemas.column_names("generic") if c != "updated_at"]
    both = J.union_tables([V.sales(spark, sf).select(*cols), V.population(spark, sf).select(*cols)])
    return both.groupBy("stats_data_id", "year").agg(F.count(F.lit(1)).alias("n"))


@query("so03_missing_columns", "SELECT count(*) AS total_records, 'region_name' AS missing, FALSE AS valid FROM sales")
def so03(spark, sf):
    report = Q.required_columns(V.sales(spark, sf), schemas.column_names("population"))
    return report.select("total_records", F.array_join("missing_columns", ",").alias("missing"), "valid")


_COMMON = ("dataset_id", "stats_data_id", "year", "region_code", "value", "unit")


@query("so04_common_columns", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, TRUE AS same_type, (SELECT count({c}) FROM economy) + (SELECT count({c}) FROM population) AS filled" for c in _COMMON))
def so04(spark, sf):
    eco, pop = V.bare(V.economy(spark, sf)), V.bare(V.population(spark, sf))
    return J.common_columns(eco, pop)
