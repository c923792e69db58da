"""Grouped statistics (AG-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidycell.functions import scalars as S
from tidycell.operators import aggregates as A
from tidycell.operators import rules
from tidycell.operators import domains
from workloads import views as V
from workloads.registry import query, view

MEAN = "round(favg(value), 4)"


@query("ag01_total_count", "SELECT count(*) AS total_records FROM sales", fine=True)
def ag01(spark, sf):
    return A.total_count(V.sales(spark, sf))


@query("ag02_value_statistics", f"""
SELECT count(*) AS count, {MEAN} AS avg_value, min(value) AS min_value, max(value) AS max_value, round(fsum(value), 4) AS sum_value FROM sales WHERE value IS NOT NULL""", fine=True)
def ag02(spark, sf):
    return A.value_statistics(V.sales(spark, sf))


@query("ag03_overview", f"""
SELECT count(*) AS record_count, count(DISTINCT dataset_id) AS unique_datasets, count(DISTINCT year) AS unique_years, count(DISTINCT region_code) AS unique_regions,
       round(fsum(value), 4) AS total_value, {MEAN} AS avg_value, min(value) AS min_value, max(value) AS max_value, min(year) AS earliest_year, max(year) AS latest_year FROM sales""", fine=True)
def ag03(spark, sf):
    return A.overview(V.sales(spark, sf))


@query("ag04_value_spread", f"""
SELECT count(value) AS non_null_values, {MEAN} AS avg_value, min(value) AS min_value, max(value) AS max_value, round(stddev_samp(value), 4) AS stddev_value FROM sales""", fine=True)
def ag04(spark, sf):
    return A.value_spread(V.sales(spark, sf))


@query("ag05_by_year", f"SELECT year, count(*) AS count, {MEAN} AS avg_value FROM sales WHERE value IS NOT NULL GROUP BY year ORDER BY year NULLS LAST LIMIT 10", fine=True)
def ag05(spark, sf):
    return A.by_year(V.sales(spark, sf))


@query("ag06_by_region", f"""
SELECT region_code, count(*) AS count, {MEAN} AS avg_value, round(fsum(value), 4) AS sum_value FROM sales WHERE value IS NOT NULL
GROUP BY region_code ORDER BY sum_value DESC NULLS LAST, region_code LIMIT 10""", fine=True)
def ag06(spark, sf):
    return A.by_region(V.sales(spark, sf))


@query("ag07_by_category", f"""
SELECT category, count(*) AS count, {MEAN} AS avg_value FROM sales WHERE value IS NOT NULL AND category IS NOT NULL GROUP BY category ORDER BY count DESC, category LIMIT 10""", fine=True)
def ag07(spark, sf):
    return A.by_category(V.sales(spark, sf))


@query("ag08_yearly_range", f"SELECT year, {MEAN} AS avg_value, min(value) AS min_value, max(value) AS max_value FROM sales WHERE value IS NOT NULL GROUP BY year ORDER BY year", fine=True)
def ag08(spark, sf):
    return A.yearly_range(V.sales(spark, sf))


@query("ag09_year_region", f"""
SELECT year, region_code, count(*) AS record_count, round(fsum(value), 4) AS total_value, {MEAN} AS avg_value, min(value) AS min_value, max(value) AS max_value
FROM economy GROUP BY year, region_code ORDER BY year DESC NULLS LAST, region_code LIMIT 100""", fine=True)
def ag09(spark, sf):
    return A.by_year_region(V.economy(spark, sf))


@query("ag09_year_region_lineitem", f"""
SELECT year, region_code, count(*) AS record_count, round(fsum(value), 4) AS total_value, {MEAN} AS avg_value, min(value) AS min_value, max(value) AS max_value
FROM labor GROUP BY year, region_code ORDER BY year DESC NULLS LAST, region_code LIMIT 100""", fine=True)
def ag09_lineitem(spark, sf):
    return A.by_year_region(V.labor(spark, sf))


@query("ag10_year_distribution", "SELECT year, count(*) AS count FROM sales GROUP BY year ORDER BY year NULLS LAST LIMIT 10", fine=True)
def ag10(spark, sf):
    return A.year_distribution(V.sales(spark, sf))


@query("ag11_category_distribution", "SELECT category, count(*) AS count FROM sales WHERE category IS NOT NULL AND category <> '' GROUP BY category ORDER BY count DESC, category LIMIT 10", fine=True)
def ag11(spark, sf):
    return A.category_distribution(V.sales(spark, sf))


@query("ag12_year_category_having", f"""
SELECT year, category, {MEAN} AS avg_value, count(*) AS sample_size FROM sales WHERE value IS NOT NULL GROUP BY year, category HAVING count(*) >= 10
ORDER BY year, avg_value DESC, category LIMIT 20""", fine=True)
def ag12(spark, sf):
    return A.by_year_category(V.sales(spark, sf))


@query("ag13_yearly_trend", f"""
SELECT year, {MEAN} AS yearly_average, count(*) AS data_points, round(stddev_samp(value), 4) AS yearly_stddev FROM sales WHERE value IS NOT NULL GROUP BY year ORDER BY year""", fine=True)
def ag13(spark, sf):
    return A.yearly_trend(V.sales(spark, sf))


_OUTLIERS = """
SELECT stats_data_id, year, category, value, z_score FROM (
  SELECT *, round(abs(value - (SELECT avg(value) FROM sales)) / NULLIF((SELECT stddev_samp(value) FROM sales), 0), 6) AS z_score FROM sales WHERE value IS NOT NULL)
WHERE z_score > {t} ORDER BY z_score DESC, seq LIMIT 10"""


view("lengths", "SELECT doc_id AS seq, source AS stats_data_id, 2020 AS year, lang AS category, CAST(n_chars AS DOUBLE) AS value FROM documents")


@query("ag14_outliers", _OUTLIERS.replace("{t}", "2").replace("sales", "lengths"))
def ag14(spark, sf):
    lengths = V.table(spark, sf, "documents").select(
        F.col("doc_id").alias("seq"), F.col("source").alias("stats_data_id"), F.lit(2020).alias("year"), F.col("lang").alias("category"), F.col("n_chars").cast("double").alias("value"))
    return A.outliers(lengths, ["seq"], 2.0).select("stats_data_id", "year", "category", "value", "z_score")


@query("ag14_outliers_wide", _OUTLIERS.replace("{t}", "1.5"))
def ag14_wide(spark, sf):
    return A.outliers(V.sales(spark, sf), ["seq"], 1.5).select("stats_data_id", "year", "category", "value", "z_score")


@query("ag15_dataset_profile", f"""
SELECT stats_data_id, count(*) AS record_count, count(DISTINCT year) AS unique_years, min(year) AS min_year, max(year) AS max_year, count(value) AS non_null_values, {MEAN} AS avg_value
FROM sales GROUP BY stats_data_id ORDER BY stats_data_id""", fine=True)
def ag15(spark, sf):
    return A.dataset_profile(V.sales(spark, sf))


@query("ag16_latest_years", f"""
SELECT year, count(*) AS record_count, {MEAN} AS avg_value FROM sales WHERE stats_data_id = 'ORDF' AND value IS NOT NULL GROUP BY year ORDER BY year DESC LIMIT 10""", fine=True)
def ag16(spark, sf):
    return A.latest_years(V.sales(spark, sf), "ORDF")


@query("ag17_region_datasets", """
SELECT region_code, count(*) AS record_count, count(DISTINCT stats_data_id) AS datasets FROM sales GROUP BY region_code ORDER BY record_count DESC, region_code LIMIT 10""", fine=True)
def ag17(spark, sf):
    return A.region_datasets(V.sales(spark, sf))


@query("ag18_per_dataset", "SELECT stats_data_id, count(*) AS record_count FROM sales GROUP BY stats_data_id ORDER BY record_count DESC", fine=True)
def ag18(spark, sf):
    return A.per_dataset(V.sales(spark, sf))


@query("ag19_busiest_years", "SELECT year, count(*) AS record_count FROM sales GROUP BY year ORDER BY record_count DESC, year LIMIT 10", fine=True)
def ag19(spark, sf):
    return A.busiest_years(V.sales(spark, sf))


@query("ag20_region_totals", """
SELECT p.region_code, COALESCE(c.name, '') AS region_name, round(fsum(value), 4) AS total_value FROM population p LEFT JOIN classes c ON p.region_code = c.code
WHERE year = 1998 GROUP BY ALL ORDER BY total_value DESC, p.region_code LIMIT 10""", fine=True)
def ag20(spark, sf):
    labelled = domains.to_domain(V.cells_customer(spark, sf), "population", codes=V.classes(spark, sf), updated_at=V.STAMP)
    return A.region_totals(labelled, 1998)


@query("ag21_year_region_totals", "SELECT year, region_code, round(fsum(value), 4) AS total_value FROM sales WHERE category = '1-URGENT' GROUP BY ALL ORDER BY year, region_code", fine=True)
def ag21(spark, sf):
    return A.year_region_totals(V.sales(spark, sf), "1-URGENT")


@query("ag22_dataset_values", f"""
SELECT stats_data_id, count(*) AS record_count, {MEAN} AS avg_value, min(value) AS min_value, max(value) AS max_value FROM sales WHERE value IS NOT NULL GROUP BY stats_data_id ORDER BY 1""", fine=True)
def ag22(spark, sf):
    return A.dataset_values(V.sales(spark, sf))


# A cross-tab of parts: age is the size, population the retail price; size 50 stands for the total.
view("ages", "SELECT CASE WHEN p_size = 50 THEN 'T01' ELSE lpad(CAST(p_size AS VARCHAR), 3, '0') END AS code, round(sum(p_retailprice), 2) AS population FROM part GROUP BY 1")


@query("ag23_age_profile", """
SELECT min(age) AS min_age, max(age) AS max_age, round(favg(population), 4) AS mean_population, arg_max(age, (population, -age)) AS peak_age, max(population) AS peak_population
FROM (SELECT CAST(code AS INTEGER) AS age, population FROM ages WHERE regexp_matches(code, '^[0-9]+$'))""", fine=True)
def ag23(spark, sf):
    code = F.when(F.col("p_size") == 50, "T01").otherwise(F.lpad(F.col("p_size").cast("string"), 3, "0"))
    ages = V.table(spark, sf, "part").groupBy(code.alias("code")).agg(F.round(F.sum("p_retailprice"), 2).alias("population"))
    return A.age_profile(ages, S.digits_only("code"), F.col("population"))


@query("ag24_split_shares", """
SELECT total, male, female, round(100 * (male / NULLIF(total, 0)), 4) AS male_percent, round(100 * (female / NULLIF(total, 0)), 4) AS female_percent FROM (
  SELECT round(fsum(CASE WHEN category = '1-URGENT' THEN value END), 4) AS total, round(fsum(CASE WHEN category = '2-HIGH' THEN value END), 4) AS male,
         round(fsum(CASE WHEN category = '3-MEDIUM' THEN value END), 4) AS female FROM sales)""", fine=True)
def ag24(spark, sf):
    return A.split_shares(V.sales(spark, sf), "category", {"male": "2-HIGH", "female": "3-MEDIUM"}, "1-URGENT")


_DIMS = ("@cat01", "@cat02", "@cat03", "@area", "@time")


@query("ag25_distinct_per_column", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT \"{c}\") AS distinct_values FROM cells_orders" for c in _DIMS), fine=True)
def ag25(spark, sf):
    return A.distinct_per_column(V.cells_orders(spark, sf), list(_DIMS))


_SKETCHED = ("@cat01", "@area", "@time", "part")


@query("ag25_distinct_approximate", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT \"{c}\") AS distinct_values, TRUE AS estimate_within_a_sixth FROM cells_lineitem" for c in _SKETCHED))
def ag25_approx(spark, sf):
    """The exact counts, and whether the sketches (standard error 5 %) came within a sixth of them."""
    cells = V.cells_lineitem(spark, sf)
    exact = A.distinct_per_column(cells, list(_SKETCHED))
    sketched = A.distinct_per_column(cells, list(_SKETCHED), approximate=True).withColumnRenamed("distinct_values", "estimate")
    close = F.abs(F.col("estimate") - F.col("distinct_values")) * 6 <= F.col("distinct_values")
    return exact.join(sketched, "column_name").select("column_name", "distinct_values", close.alias("estimate_within_a_sixth"))


_TERMS = ("世帯所得", "年齢階級", "都道府県別", "就業者数", "世帯人員", "婚姻件数", "学校数", "住宅数", "製造業", "気温")
_TERM_CASE = "CASE " + " ".join(
    f"WHEN regexp_matches(suggested, '{'|'.join(terms)}') THEN '{g}'" for g, terms in A.TERM_GROUPS) + " ELSE 'その他' END"
_PICK = "CASE p_size % 10 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TERMS)) + " END"


@query("ag26_term_statistics", f"""
SELECT {_TERM_CASE} AS category, count(*) AS term_count FROM (SELECT {_PICK} || p_name AS suggested FROM part) GROUP BY 1""", fine=True)
def ag26(spark, sf):
    terms = V.table(spark, sf, "part").select(F.concat(F.expr(_PICK), "p_name").alias("suggested"))
    return A.term_statistics(terms)


@query("ag26_rule_table", f"""
SELECT {_TERM_CASE} AS category, count(*) AS term_count FROM (SELECT {_PICK} || p_name AS suggested FROM part) GROUP BY 1""", fine=True)
def ag26_rules(spark, sf):
    """The same groups from a table of rules."""
    terms = V.table(spark, sf, "part").select(F.concat(F.expr(_PICK), "p_name").alias("suggested"))
    found = rules.categorised(terms, rules.rule_table(spark, A.TERM_GROUPS), "suggested", "category", "その他")
    return found.groupBy("category").agg(F.count("*").alias("term_count"))
