"""Data quality (DQ-*)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tidycell import schemas

from tidycell.operators import quality as Q
from tidycell.sources import tables
from workloads import views as V
from workloads.registry import query, view

_REQUIRED = ["dataset_id", "year", "region_code", "value", "quarter"]


@query("dq01_required_columns", """
SELECT count(*) AS total_records, 'quarter' AS missing, 'category,dataset_id,region_code,seq,stats_data_id,unit,updated_at,value,year' AS actual, FALSE AS valid FROM sales""")
def dq01(spark, sf):
    report = Q.required_columns(V.sales(spark, sf), _REQUIRED)
    join = lambda c: F.array_join(c, ",")
    return report.select("total_records", join("missing_columns").alias("missing"), join("actual_columns").alias("actual"), "valid")


@query("dq02_null_counts", """
SELECT column_name, null_count, total_records FROM (
  SELECT '$' AS column_name, count(*) FILTER (WHERE "$" IS NULL OR "$" IN ('', 'null')) AS null_count, count(*) AS total_records FROM cells_orders
  UNION ALL SELECT '@area', count(*) FILTER (WHERE "@area" IS NULL OR "@area" IN ('', 'null')), count(*) FROM cells_orders) WHERE null_count > 0""")
def dq02(spark, sf):
    return Q.null_counts(V.cells_orders(spark, sf), ["@area", "@time", "$"])


@query("dq02_null_counts_typed", """
SELECT 'value' AS column_name, count(*) FILTER (WHERE value IS NULL) AS null_count, count(*) AS total_records FROM sales""")
def dq02_typed(spark, sf):
    return Q.null_counts(V.sales(spark, sf), ["dataset_id", "year", "value"])


@query("dq03_value_range", """
SELECT count(*) AS total_records, count(*) FILTER (WHERE value < 0 OR value > 9000) AS out_of_range_count, count(*) FILTER (WHERE value < 0 OR value > 9000) = 0 AS valid FROM population""")
def dq03(spark, sf):
    return Q.out_of_range(V.population(spark, sf), "value", 0, 9000)


@query("dq03_range_offenders", """
SELECT seq, measure, CASE WHEN v < 0 THEN 'Below minimum (0)' ELSE 'Above maximum (9000)' END AS reason FROM (
  SELECT seq, "$" AS measure, TRY_CAST("$" AS DOUBLE) AS v FROM cells_customer) WHERE v < 0 OR v > 9000 ORDER BY seq LIMIT 10""")
def dq03_offenders(spark, sf):
    bad = Q.range_offenders(V.cells_customer(spark, sf), "$", ["seq"], 0, 9000)
    return bad.select("seq", F.col("`$`").alias("measure"), "reason")


_KEYS = "dataset_id, year, region_code"


@query("dq04_duplicate_keys", f"SELECT {_KEYS}, count(*) AS count FROM sales GROUP BY ALL HAVING count(*) > 1")
def dq04(spark, sf):
    return Q.duplicate_keys(V.sales(spark, sf), ["dataset_id", "year", "region_code"])


@query("dq04_duplicate_summary", """
SELECT count(*) FILTER (WHERE n > 1) AS duplicate_count, CAST(COALESCE(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS total_duplicate_records,
       CAST(sum(n) AS BIGINT) AS total_records, count(*) FILTER (WHERE n > 1) > 0 AS has_duplicates
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)""")
def dq04_summary(spark, sf):
    return Q.duplicate_summary(V.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("dq04_duplicate_details", """
SELECT l_orderkey, l_linenumber, count(*) AS count FROM lineitem GROUP BY ALL HAVING count(*) > 1 ORDER BY count DESC, l_orderkey, l_linenumber LIMIT 10""")
def dq04_details(spark, sf):
    return Q.duplicate_details(V.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("dq04_duplicate_texts", "SELECT text, count(*) AS count FROM documents GROUP BY text HAVING count(*) > 1")
def dq04_texts(spark, sf):
    return Q.duplicate_texts(V.table(spark, sf, "documents"), "text")


def _rules():
    return {"no_value": Q.is_blank("value"), "negative": F.coalesce(F.col("value") < 1000, F.lit(False)), "late": F.col("year") > 2000}


view("annotated", """
SELECT *, concat_ws(',', CASE WHEN value IS NULL THEN 'no_value' END, CASE WHEN value < 1000 THEN 'negative' END, CASE WHEN year > 2000 THEN 'late' END,
   CASE WHEN count(*) OVER (PARTITION BY dataset_id, stats_data_id, year, region_code, category, value) > 1 THEN 'duplicate' END) AS reasons FROM sales""")
_UNIQUE = ["dataset_id", "stats_data_id", "year", "region_code", "category", "value"]


@query("dq05_quarantine", """
SELECT seq, reasons = '' AS accepted, reasons FROM annotated""")
def dq05(spark, sf):
    annotated = Q.with_reasons(V.sales(spark, sf), _rules(), _UNIQUE)
    return annotated.select("seq", (F.size("reasons") == 0).alias("accepted"), F.array_join("reasons", ",").alias("reasons"))


@query("dq05_quarantine_split", "SELECT year, reasons = '' AS accepted, count(*) AS n FROM annotated GROUP BY ALL")
def dq05_split(spark, sf):
    good, bad = Q.quarantine(tables.stage(spark, V.sales(spark, sf), "dq05"), _rules(), _UNIQUE)
    count = lambda df, ok: df.groupBy("year").agg(F.count(F.lit(1)).alias("n")).select("year", F.lit(ok).alias("accepted"), "n")
    return count(good, True).unionByName(count(bad, False))


@query("dq06_gate", """
SELECT count(*) AS total_records, CAST(0 AS BIGINT) AS null_dataset_id, CAST(0 AS BIGINT) AS null_year, count(*) - count(value) AS null_value,
       (SELECT count(*) FROM (SELECT 1 FROM sales GROUP BY dataset_id, year, region_code HAVING count(*) > 1)) AS duplicate_keys, 0 AS missing_columns, FALSE AS valid FROM sales""")
def dq06(spark, sf):
    return Q.gate(V.sales(spark, sf).drop("seq"), schemas.column_names("generic"), check_duplicates=True)


@query("dq06_gate_passes", """
SELECT count(*) AS total_records, CAST(0 AS BIGINT) AS null_dataset_id, CAST(0 AS BIGINT) AS null_year, CAST(0 AS BIGINT) AS null_value,
       CAST(0 AS BIGINT) AS duplicate_keys, 0 AS missing_columns, TRUE AS valid FROM labor""")
def dq06_passes(spark, sf):
    return Q.gate(V.labor(spark, sf), schemas.column_names("labor"))


@query("dq07_completeness", """
SELECT o_orderkey AS dataset_id, CAST(o_custkey % 7 AS BIGINT) AS expected, COALESCE(n, 0) AS fetched, COALESCE(COALESCE(n, 0) / NULLIF(o_custkey % 7, 0), 0) AS ratio
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def dq07(spark, sf):
    expected = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("dataset_id"), (F.col("o_custkey") % 7).alias("expected"))
    return Q.completeness(V.table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "dataset_id"), expected, "dataset_id")


@query("dq08_duplication_factor", """
SELECT stats_data_id, n AS expected, 2 * n AS fetched, CAST(2 AS DOUBLE) AS ratio FROM (SELECT stats_data_id, count(*) AS n FROM sales GROUP BY 1)""")
def dq08(spark, sf):
    s = V.sales(spark, sf)
    expected = s.groupBy("stats_data_id").agg(F.count(F.lit(1)).alias("expected"))
    return Q.completeness(s.unionByName(s), expected, "stats_data_id")


@query("dq09_summary", """
SELECT rule, failures, total FROM (SELECT count(*) AS total, count(*) - count(value) AS a, count(*) FILTER (WHERE value < 1000) AS b, count(*) FILTER (WHERE year > 2000) AS c FROM sales),
LATERAL (VALUES ('no_value', a), ('negative', b), ('late', c)) AS r(rule, failures)""")
def dq09(spark, sf):
    return Q.summary(V.sales(spark, sf), _rules())


# Of every domain's table, as mapped from the same cells: what it should hold, and whether it does.
_REGISTERED = [(d, c, t, "measure" if c == "value" else "dimension") for d in schemas.DOMAINS for c, t in schemas.columns(d)]


def _profiles(spark, sf, change=lambda domain, df: df):
    from tidycell.sources.files import parquet_profile
    held = [
        parquet_profile(change(d, V.mapped(spark, sf, d, "cells_sales", "X", "null"))).select(F.lit(d).alias("domain"), "column_name", F.col("type").alias("held"), F.col("non_null").alias("filled"))
        for d in schemas.DOMAINS]
    return reduce(lambda a, b: a.unionByName(b), held)


def _dq10_sql(verdict="'ok'", filled="CASE column_name WHEN 'value' THEN v ELSE n END"):
    rows = ", ".join(str(r) for r in _REGISTERED)
    return f"""
SELECT domain, column_name, role, {verdict} AS verdict, {filled} AS filled FROM (SELECT count(*) AS n, count(value) AS v FROM sales),
(VALUES {rows}) AS r(domain, column_name, type, role)"""


@query("dq10_schema_checks", _dq10_sql())
def dq10(spark, sf):
    return Q.schema_verdicts(Q.registry(spark), _profiles(spark, sf)).select("domain", "column_name", "role", "verdict", "filled")


@query("dq10_schema_faults", _dq10_sql(
    "CASE WHEN domain = 'labor' AND column_name = 'industry_code' THEN 'missing' WHEN domain = 'trade' AND column_name = 'year' THEN 'type' ELSE 'ok' END",
    "CASE WHEN domain = 'labor' AND column_name = 'industry_code' THEN NULL WHEN column_name = 'value' THEN v ELSE n END"))
def dq10_faults(spark, sf):
    def change(domain, df):
        if domain == "labor":
            return df.drop("industry_code")
        return df.withColumn("year", F.col("year").cast("bigint")) if domain == "trade" else df

    return Q.schema_verdicts(Q.registry(spark), _profiles(spark, sf, change)).select("domain", "column_name", "role", "verdict", "filled")


@query("dq10_type_conflicts", "SELECT column_name, types FROM (SELECT column_name, count(DISTINCT type) AS types FROM (VALUES " + ", ".join(
    str(r) for r in _REGISTERED) + ") AS r(domain, column_name, type, role), (SELECT count(*) AS n FROM sales) GROUP BY 1) WHERE types = 1")
def dq10_conflicts(spark, sf):
    """Columns whose types agree over the tables of all domains: the ones that are not in conflict."""
    held = _profiles(spark, sf).withColumnRenamed("held", "type")
    return held.join(Q.schema_conflicts(held), "column_name", "left_anti").groupBy("column_name").agg(F.countDistinct("type").alias("types"))
