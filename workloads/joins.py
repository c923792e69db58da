"""Joins (JN-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidycell.operators import joins as J
from tidycell.operators import labels
from workloads import views as V
from workloads.registry import query, view

view("pop_series", "SELECT year, region_code, round(fsum(value), 4) AS population FROM population WHERE category = 'BUILDING' GROUP BY ALL")
view("eco_series", "SELECT year, region_code, round(fsum(value), 4) AS gdp FROM economy WHERE indicator = '1-URGENT' GROUP BY ALL")
view("lab_series", "SELECT year, region_code, round(fsum(value), 4) AS labor_force FROM labor GROUP BY ALL")


def _pop(spark, sf):
    return J.series(V.population(spark, sf).filter("category = 'BUILDING'"), "population")


def _eco(spark, sf):
    return J.series(V.economy(spark, sf).filter("indicator = '1-URGENT'"), "gdp")


@query("jn01_inner", """
SELECT e.year, e.region_code, e.indicator, e.quarter, p.population, e.value AS gdp FROM economy e JOIN pop_series p ON p.year = e.year AND p.region_code = e.region_code WHERE p.year >= 1998""", fine=True)
def jn01(spark, sf):
    eco = V.economy(spark, sf).filter("year >= 1998").select("year", "region_code", "indicator", "quarter", F.col("value").alias("gdp"))
    return J.join_series(eco, _pop(spark, sf))


@query("jn02_left", """
SELECT p.year, p.region_code, p.category, p.value AS population, e.gdp FROM population p LEFT JOIN eco_series e ON p.year = e.year AND p.region_code = e.region_code""", fine=True)
def jn02(spark, sf):
    pop = V.population(spark, sf).select("year", "region_code", "category", F.col("value").alias("population"))
    return J.join_series(pop, _eco(spark, sf), "left")


@query("jn03_join_and_aggregate", """
SELECT p.year, count(DISTINCT p.region_code) AS region_count, round(fsum(p.value), 4) AS total_population,
       round(favg(e.value), 4) AS avg_gdp
FROM population p JOIN economy e ON p.year = e.year AND p.region_code = e.region_code GROUP BY p.year""", fine=True)
def jn03(spark, sf):
    joined = J.joined_statistics(V.population(spark, sf), V.economy(spark, sf))
    return joined.withColumnsRenamed({"left_total": "total_population", "right_avg": "avg_gdp"})


@query("jn04_three_way", """
SELECT p.year, p.region_code, p.population, e.gdp, l.labor_force FROM pop_series p JOIN eco_series e ON p.year = e.year AND p.region_code = e.region_code
JOIN lab_series l ON p.year = l.year AND p.region_code = l.region_code WHERE p.year >= 1996""", fine=True)
def jn04(spark, sf):
    parts = [
        df.filter("year >= 1996")
        for df in (_pop(spark, sf), _eco(spark, sf), J.series(V.labor(spark, sf), "labor_force"))
    ]
    return J.join_all(parts)


@query("jn05_inventory_counts", """
SELECT id AS dataset_id, name AS dataset_name, domain, (SELECT count(*) FROM sales) AS record_count FROM inventory WHERE domain || '_data' = 'population_data'""", fine=True)
def jn05(spark, sf):
    inv = V.inventory(spark, sf).select(F.col("id").alias("dataset_id"), F.col("name").alias("dataset_name"), "domain", F.concat("domain", F.lit("_data")).alias("table_name"))
    return J.inventory_counts(inv, V.sales(spark, sf), "population_data")


@query("jn06_with_statistics", """
SELECT seq, value, round((SELECT avg(value) FROM sales), 4) AS mean_val, round((SELECT stddev_samp(value) FROM sales), 4) AS std_val FROM sales""")
def jn06(spark, sf):
    df = J.with_statistics(V.sales(spark, sf))
    return df.select("seq", "value", F.round("mean_val", 4).alias("mean_val"), F.round("std_val", 4).alias("std_val"))


@query("jn07_code_dimension", """
SELECT l_orderkey, l_linenumber, l_quantity, COALESCE(c.name, '') AS part_name FROM lineitem LEFT JOIN part_codes c ON lpad(CAST(l_partkey AS VARCHAR), 9, '0') = c.code""", fine=True)
def jn07(spark, sf):
    li = V.table(spark, sf, "lineitem").withColumn("item", F.lpad(F.col("l_partkey").cast("string"), 9, "0"))
    return labels.with_label(li, V.part_codes(spark, sf), "item", "item", "part_name").select("l_orderkey", "l_linenumber", "l_quantity", "part_name")


@query("jn08_semi_and_anti", """
SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50) AS selected FROM orders""", fine=True)
def jn08(spark, sf):
    o = V.table(spark, sf, "orders").select("o_orderkey")
    ids = V.table(spark, sf, "lineitem").filter("l_quantity = 50").select(F.col("l_orderkey").alias("o_orderkey"))
    return o.join(ids, "o_orderkey", "left_semi").withColumn("selected", F.lit(True)).unionByName(
        o.join(ids, "o_orderkey", "left_anti").withColumn("selected", F.lit(False)))


@query("jn09_hierarchy", """
SELECT c.code, c.name, c.level, p.name AS parent_name, COALESCE(k.n, 0) AS children FROM part_codes c LEFT JOIN part_codes p ON c.parent_code = p.code
LEFT JOIN (SELECT parent_code, count(*) AS n FROM part_codes WHERE parent_code <> '' GROUP BY 1) k ON c.code = k.parent_code""", fine=True)
def jn09(spark, sf):
    codes = V.part_codes(spark, sf)
    counted = labels.children_per_parent(codes).select("code", "children")
    return labels.with_parent(codes).join(counted, "code").select("code", "name", "level", "parent_name", "children")


@query("jn09_whole_hierarchy", """
WITH p AS (SELECT lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS code, p_brand, p_size FROM part)
SELECT 'ALL' AS code, 0::BIGINT AS depth, 'ALL' AS path, count(*) AS n, CAST(sum(p_size) AS DOUBLE) AS total FROM p
UNION ALL SELECT p_brand, 1, 'ALL > ' || p_brand, count(*), sum(p_size) FROM p GROUP BY p_brand
UNION ALL SELECT code, 2, 'ALL > ' || p_brand || ' > ' || code, 1, p_size FROM p""")
def jn09_whole(spark, sf):
    """Depth and path of every code, and the sizes of all parts below it."""
    codes = V.part_codes(spark, sf).drop("code_pos", "name", "level")
    codes = codes.withColumn("parent_code", F.when(F.col("parent_code") == "", "ALL").otherwise(F.col("parent_code")))
    codes = codes.unionByName(codes.limit(1).select("category_id", F.lit("ALL").alias("code"), F.lit("").alias("parent_code")))
    sizes = V.table(spark, sf, "part").select(
        F.lit("item").alias("category_id"), F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("code"), F.col("p_size").cast("double").alias("value"))
    totals = labels.rolled_up(codes, sizes).select("code", "n", "total")
    return labels.hierarchy(codes).where("not circular").select("code", "depth", "path").join(totals, "code")
