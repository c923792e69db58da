"""Statistical cells derived from the given tables, in Spark and in SQL.

``ORD`` cells come from orders, ``LIN`` from lineitem, ``CUS`` from customers, the area
codes from nations and regions, the catalogue from documents and the logs from events.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidycell import schemas
from tidycell.operators import domains
from workloads.registry import view

STAMP = dt.datetime(2024, 1, 1)
AS_OF = dt.date(2024, 6, 30)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame, rows: int = 5000) -> DataFrame:
    """The rows of a table dealt to tasks of so many rows, for work on rows that grow into whole documents: the files
    of a narrow table are few, and one task would make and read all documents of a file."""
    return df.repartition(max(1, -(-df.count() // rows)))


# --- text of numbers and codes -------------------------------------------------------------

def area(nationkey) -> Column:
    return F.concat(F.lpad((F.col(nationkey) + 1).cast("string"), 2, "0"), F.lit("000"))


def money(x, grouped: bool = False) -> Column:
    """Two decimals, with thousands separators on request."""
    return F.format_number(x, 2) if grouped else F.col(x).cast("decimal(18,2)").cast("string")


AREA = "lpad(CAST({k} + 1 AS VARCHAR), 2, '0') || '000'"


def sql_area(k: str) -> str:
    return AREA.replace("{k}", k)


def sql_money(x: str, grouped: bool = False) -> str:
    return f"format('{{:,.2f}}', {x})" if grouped else f"CAST(CAST({x} AS DECIMAL(18, 2)) AS VARCHAR)"


def _suppressed(text: Column) -> Column:
    return F.when(F.col("o_orderkey") % 97 == 0, "-").when(F.col("o_orderkey") % 89 == 0, "").otherwise(text)


def _sql_suppressed(text: str) -> str:
    return f"CASE WHEN o_orderkey % 97 = 0 THEN '-' WHEN o_orderkey % 89 = 0 THEN '' ELSE {text} END"


# --- wire cells ----------------------------------------------------------------------------

def cells_orders(spark: SparkSession, sf: str, grouped: bool = True) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    time = F.concat(F.year("o_orderdate"), F.lit("Q"), F.quarter("o_orderdate"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.concat(F.lit("ORD"), "o_orderstatus").alias("@id"), F.col("o_orderkey").cast("string").alias("@tab"),
        F.col("o_orderpriority").alias("@cat01"), F.col("o_orderstatus").alias("@cat02"),
        F.col("c_mktsegment").alias("@cat03"),
        area("c_nationkey").alias("@area"), time.alias("@time"), F.lit("yen").alias("@unit"),
        _suppressed(money("o_totalprice", grouped)).alias("$"), F.col("o_orderkey").alias("seq"),
    )


def _sql_orders(grouped: bool) -> str:
    return f"""
SELECT 'ORD' || o_orderstatus AS "@id", CAST(o_orderkey AS VARCHAR) AS "@tab", o_orderpriority AS "@cat01", o_orderstatus AS "@cat02", c_mktsegment AS "@cat03",
       {sql_area('c_nationkey')} AS "@area",
       CAST(year(o_orderdate) AS VARCHAR) || 'Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS "@time", 'yen' AS "@unit",
       {_sql_suppressed(sql_money('o_totalprice', grouped))} AS "$", o_orderkey AS seq
FROM orders JOIN customer ON o_custkey = c_custkey"""


view("cells_orders", _sql_orders(True))
view("cells_sales", _sql_orders(False))


def cells_sales(spark, sf):
    return cells_orders(spark, sf, grouped=False)


def cells_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    li, s = table(spark, sf, "lineitem"), table(spark, sf, "supplier")
    return li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.lit("LIN").alias("@id"), F.col("l_returnflag").alias("@cat01"), F.col("l_linestatus").alias("@cat02"),
        F.lit("quantity").alias("@cat03"), area("s_nationkey").alias("@area"),
        F.date_format("l_shipdate", "yyyyMM").alias("@time"), F.lit("unit").alias("@unit"),
        F.col("l_quantity").cast("int").cast("string").alias("$"),
        F.col("l_orderkey").alias("seq"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
    )


view("cells_lineitem", f"""
SELECT 'LIN' AS "@id", l_returnflag AS "@cat01", l_linestatus AS "@cat02", 'quantity' AS "@cat03",
       {sql_area('s_nationkey')} AS "@area", strftime(l_shipdate, '%Y%m') AS "@time", 'unit' AS "@unit",
       CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS "$",
       l_orderkey AS seq, l_linenumber AS line, l_partkey AS part
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""")


def cells_customer(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.lit("CUS").alias("@id"), F.col("c_custkey").cast("string").alias("@tab"), F.col("c_mktsegment").alias("@cat01"),
        F.col("c_nationkey").cast("string").alias("@cat02"), F.lit("balance").alias("@cat03"),
        area("c_nationkey").alias("@area"), (F.lit(1995) + F.col("c_custkey") % 7).cast("string").alias("@time"),
        F.lit("yen").alias("@unit"), money("c_acctbal").alias("$"), F.col("c_custkey").alias("seq"),
    )


view("cells_customer", f"""
SELECT 'CUS' AS "@id", CAST(c_custkey AS VARCHAR) AS "@tab", c_mktsegment AS "@cat01", CAST(c_nationkey AS VARCHAR) AS "@cat02", 'balance' AS "@cat03",
       {sql_area('c_nationkey')} AS "@area", CAST(1995 + c_custkey % 7 AS VARCHAR) AS "@time", 'yen' AS "@unit",
       {sql_money('c_acctbal')} AS "$", c_custkey AS seq
FROM customer""")

CELLS = {"cells_orders": cells_orders, "cells_sales": cells_sales, "cells_lineitem": cells_lineitem, "cells_customer": cells_customer}


# --- the mapping in SQL --------------------------------------------------------------------

NUMBER = "^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def sql_measure(v: str, on_bad: str) -> str:
    if on_bad == "zero":
        t = f"trim(replace({v}, ',', ''))"
        return f"CASE WHEN regexp_matches({t}, '{NUMBER}') THEN TRY_CAST({t} AS DOUBLE) ELSE 0.0 END"
    t = f"trim({v})"
    return f"CASE WHEN {v} IS NULL THEN 0.0 WHEN regexp_matches({t}, '{NUMBER}') THEN TRY_CAST({t} AS DOUBLE) END"


def sql_year(t: str, default: str = "2020") -> str:
    return f"COALESCE(TRY_CAST(NULLIF(regexp_extract({t}, '([0-9]{{4}})', 1), '') AS INTEGER), {default})"


def sql_quarter(t: str) -> str:
    return f"COALESCE(TRY_CAST(NULLIF(regexp_extract({t}, '[Qq]([1-4])', 1), '') AS INTEGER), 0)"


def sql_month(t: str) -> str:
    tries = ", ".join(
        f"TRY_CAST(NULLIF(regexp_extract({t}, '{p}', 1), '') AS INTEGER)"
        for p in ("[0-9]{4}-([0-9]{2})", "[0-9]{4}([0-9]{2})[0-9]{2}", "[0-9]{4}([0-9]{2})")
    )
    return f"COALESCE({tries}, 0)"


def sql_domain(domain: str, cells: str, dataset_id: str | None = None, on_bad: str = "zero", extra: str = "") -> str:
    """The mapping projection without labels and without the load time."""
    def source(d):
        if d.source == "quarter":
            return sql_quarter('"@time"')
        if d.source == "month":
            return sql_month('"@time"')
        if d.source.startswith("label:"):
            return "''"
        return f"COALESCE(\"{d.source}\", '')"

    dims = ", ".join(f"{source(d)} AS {d.name}" for d in schemas.DOMAINS[domain])
    dataset = f"'{dataset_id}'" if dataset_id else '"@id"'
    return (
        f'SELECT {dataset} AS dataset_id, "@id" AS stats_data_id, {sql_year(chr(34) + "@time" + chr(34))} AS year, {dims}, '
        f'{sql_measure(chr(34) + "$" + chr(34), on_bad)} AS value, "@unit" AS unit{extra} FROM {cells}'
    )


def mapped(spark, sf, domain, cells, dataset_id=None, on_bad="zero", keep=(), codes=None) -> DataFrame:
    df = domains.to_domain(
        CELLS[cells](spark, sf), domain, dataset_id, codes=codes, on_bad=on_bad, updated_at=STAMP, keep=keep
    )
    return df


def bare(df: DataFrame) -> DataFrame:
    """Without the load time, which is no part of a comparison."""
    return df.drop("updated_at")


# --- tidy tables the analyses run on -------------------------------------------------------

view("sales", sql_domain("generic", "cells_sales", "S1", "null", ", seq"))
view("economy", sql_domain("economy", "cells_sales", "E1", "null"))
view("labor", sql_domain("labor", "cells_lineitem"))
view("population", sql_domain("population", "cells_customer"))


def sales(spark, sf):
    return mapped(spark, sf, "generic", "cells_sales", "S1", "null", keep=("seq",))


def economy(spark, sf):
    return mapped(spark, sf, "economy", "cells_sales", "E1", "null")


def labor(spark, sf):
    return mapped(spark, sf, "labor", "cells_lineitem")


def population(spark, sf):
    return mapped(spark, sf, "population", "cells_customer")


# --- code lists ----------------------------------------------------------------------------

def classes(spark: SparkSession, sf: str) -> DataFrame:
    r, n = table(spark, sf, "region"), table(spark, sf, "nation")
    top = r.select(
        F.concat(F.lit("R"), "r_regionkey").alias("code"), F.col("r_name").alias("name"), F.lit("1").alias("level"),
        F.lit("").alias("parent_code"), F.col("r_regionkey").alias("code_pos"),
    )
    low = n.select(
        area("n_nationkey").alias("code"), F.col("n_name").alias("name"), F.lit("2").alias("level"),
        F.concat(F.lit("R"), "n_regionkey").alias("parent_code"), (F.col("n_nationkey") + 100).alias("code_pos"),
    )
    return top.unionByName(low).select(
        F.lit("area").alias("category_id"), F.lit("Area").alias("category_name"), "code", "name", "level",
        "parent_code", F.lit("").alias("unit"), F.lit(0).alias("category_pos"), "code_pos",
    )


view("classes", f"""
SELECT 'area' AS category_id, 'Area' AS category_name, code, name, level, parent_code, '' AS unit, 0 AS category_pos, code_pos
FROM (SELECT 'R' || r_regionkey AS code, r_name AS name, '1' AS level, '' AS parent_code, r_regionkey AS code_pos FROM region
      UNION ALL
      SELECT {sql_area('n_nationkey')}, n_name, '2', 'R' || n_regionkey, n_nationkey + 100 FROM nation)""")


def part_codes(spark: SparkSession, sf: str) -> DataFrame:
    """A two-level code list that grows with the data: brands above parts."""
    p = table(spark, sf, "part")
    brands = p.select("p_brand").distinct().select(
        F.col("p_brand").alias("code"), F.col("p_brand").alias("name"), F.lit("1").alias("level"),
        F.lit("").alias("parent_code"), F.lit(-1).cast("bigint").alias("code_pos"),
    )
    parts = p.select(
        F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("code"), F.col("p_name").alias("name"),
        F.lit("2").alias("level"), F.col("p_brand").alias("parent_code"), F.col("p_partkey").alias("code_pos"),
    )
    return brands.unionByName(parts).select(F.lit("item").alias("category_id"), "code", "name", "level", "parent_code", "code_pos")


view("part_codes", """
SELECT 'item' AS category_id, code, name, level, parent_code, code_pos
FROM (SELECT DISTINCT p_brand AS code, p_brand AS name, '1' AS level, '' AS parent_code, -1 AS code_pos FROM part
      UNION ALL
      SELECT lpad(CAST(p_partkey AS VARCHAR), 9, '0'), p_name, '2', p_brand, p_partkey FROM part)""")


# --- catalogue -----------------------------------------------------------------------------

def catalogue(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    opened = F.date_add(F.lit(dt.date(2013, 1, 1)), (F.col("n_chars") % 4000).cast("int")).cast("string")
    return d.select(
        F.col("doc_id").alias("position"), F.lpad(F.col("doc_id").cast("string"), 10, "0").alias("id"),
        F.array_join(F.regexp_extract_all("text", F.lit("[a-z]{12,}"), F.lit(0)), " ").alias("title"),
        F.concat(F.lit("Survey "), "lang").alias("statistics_name"), F.col("lang").alias("main_category"),
        F.col("source").alias("sub_category"), F.col("text").alias("description"),
        F.when(F.col("source").isin("src1", "src3", "src7"), "総務省統計局").otherwise(F.col("source")).alias("gov_org"),
        F.when(F.col("lang") == "de", "").when(F.col("lang") == "es", "2015/01").otherwise(opened).alias("open_date"),
        F.when(F.col("n_chars") > 2000, "long").otherwise("").alias("title_spec"),
        F.lit("2020").alias("survey_date"), opened.alias("updated_date"), "n_chars",
    )


view("catalogue", """
SELECT doc_id AS position, lpad(CAST(doc_id AS VARCHAR), 10, '0') AS id, array_to_string(regexp_extract_all(text, '[a-z]{12,}'), ' ') AS title,
       'Survey ' || lang AS statistics_name, lang AS main_category, source AS sub_category, text AS description,
       CASE WHEN source IN ('src1', 'src3', 'src7') THEN '総務省統計局' ELSE source END AS gov_org,
       CASE WHEN lang = 'de' THEN '' WHEN lang = 'es' THEN '2015/01'
            ELSE CAST(DATE '2013-01-01' + CAST(n_chars % 4000 AS INTEGER) AS VARCHAR) END AS open_date,
       CASE WHEN n_chars > 2000 THEN 'long' ELSE '' END AS title_spec, '2020' AS survey_date,
       CAST(DATE '2013-01-01' + CAST(n_chars % 4000 AS INTEGER) AS VARCHAR) AS updated_date, n_chars
FROM documents""")


# --- logs ----------------------------------------------------------------------------------

def status_log(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").when(
        F.col("event_type") == "click", "processing").otherwise("pending")
    return e.select(
        F.col("user_id").alias("dataset_id"), status.alias("status"), "ts", "event_id", F.col("value"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"), "event_type",
    )


view("status_log", """
SELECT user_id AS dataset_id,
       CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' WHEN 'click' THEN 'processing' ELSE 'pending' END AS status,
       ts, event_id, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type
FROM events""")


def inventory(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    domain = F.when(F.col("c_mktsegment") == "BUILDING", "construction").when(
        F.col("c_mktsegment") == "AUTOMOBILE", "transport").when(F.col("c_mktsegment") == "HOUSEHOLD", "population").otherwise("economy")
    status = F.when(F.col("c_acctbal") < 0, "failed").when(F.col("c_acctbal") < 3000, "completed").when(
        F.col("c_acctbal") < 4000, "processing").otherwise("pending")
    return c.select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), domain.alias("domain"),
        (F.col("c_nationkey") % 10 + 1).alias("priority"), status.alias("status"), F.col("c_custkey").alias("added_pos"),
        "c_nationkey", "c_mktsegment",
    )


view("inventory", """
SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'construction' WHEN 'AUTOMOBILE' THEN 'transport' WHEN 'HOUSEHOLD' THEN 'population' ELSE 'economy' END AS domain,
       c_nationkey % 10 + 1 AS priority,
       CASE WHEN c_acctbal < 0 THEN 'failed' WHEN c_acctbal < 3000 THEN 'completed' WHEN c_acctbal < 4000 THEN 'processing' ELSE 'pending' END AS status,
       c_custkey AS added_pos, c_nationkey, c_mktsegment
FROM customer""")
