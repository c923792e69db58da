"""Projections and domain mappings (PR-*, DM-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidycell import schemas
from tidycell.functions import metadata as M
from tidycell.functions import scalars as S
from tidycell.operators import domains, joins, labels, rules
from tidycell.sources import wire
from workloads import views as V
from workloads.registry import query, view

T = '"@time"'


def raw_path():
    return F.concat(F.lit("raw/data/"), F.lpad(F.col("o_custkey").cast("string"), 10, "0"), F.lit("_chunk_"), F.col("o_orderkey"), F.lit(".json"))


@query("pr01_dataset_id", """
SELECT dataset_id, count(*) AS files FROM (
  SELECT split_part(list_last(string_split('raw/data/' || lpad(CAST(o_custkey AS VARCHAR), 10, '0') || '_chunk_' || o_orderkey || '.json', '/')), '_', 1) AS dataset_id
  FROM orders) GROUP BY dataset_id""")
def pr01(spark, sf):
    ids = V.table(spark, sf, "orders").select(S.dataset_id_from_path(raw_path()).alias("dataset_id"))
    return ids.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("files"))


@query("pr02_measure_zero", f'SELECT seq, {V.sql_measure(chr(34) + "$" + chr(34), "zero")} AS value FROM cells_orders')
def pr02(spark, sf):
    return V.cells_orders(spark, sf).select("seq", S.measure("`$`", "zero").alias("value"))


@query("pr03_measure_null", f"""
SELECT seq, {V.sql_measure(chr(34) + "$" + chr(34), "null")} AS value FROM cells_sales
UNION ALL SELECT seq, {V.sql_measure(chr(34) + "$" + chr(34), "null")} FROM cells_orders""")
def pr03(spark, sf):
    both = V.cells_sales(spark, sf).unionByName(V.cells_orders(spark, sf))
    return both.select("seq", S.measure("`$`", "null").alias("value"))


@query("pr04_year", f"""
SELECT seq, {V.sql_year(T)} AS year, {V.sql_year("substr(" + T + ", 1, 2)")} AS defaulted,
       {V.sql_year("substr(" + T + ", 1, 2)", "NULL")} IS NULL AS is_unknown FROM cells_orders""")
def pr04(spark, sf):
    short = F.substring("`@time`", 1, 2)
    return V.cells_orders(spark, sf).select(
        "seq", S.year("`@time`").alias("year"), S.year(short).alias("defaulted"), S.year(short, None).isNull().alias("is_unknown")
    )


@query("pr05_quarter", f"""
SELECT seq, {V.sql_quarter(T)} AS quarter, {V.sql_quarter("lower(" + T + ")")} AS lowered, {V.sql_quarter("substr(" + T + ", 1, 4)")} AS absent
FROM cells_orders""")
def pr05(spark, sf):
    return V.cells_orders(spark, sf).select(
        "seq", S.quarter("`@time`").alias("quarter"), S.quarter(F.lower("`@time`")).alias("lowered"),
        S.quarter(F.substring("`@time`", 1, 4)).alias("absent"),
    )


@query("pr06_month", f"""
SELECT ym, month, dashed, day, n FROM (
  SELECT {T} AS ym, {V.sql_month(T)} AS month, {V.sql_month("substr(" + T + ",1,4) || '-' || substr(" + T + ",5,2)")} AS dashed,
         {V.sql_month(T + " || '15'")} AS day, count(*) AS n FROM cells_lineitem GROUP BY 1, 2, 3, 4)""")
def pr06(spark, sf):
    t = F.col("`@time`")
    dashed = F.concat(F.substring(t, 1, 4), F.lit("-"), F.substring(t, 5, 2))
    parsed = V.cells_lineitem(spark, sf).select(
        t.alias("ym"), S.month(t).alias("month"), S.month(dashed).alias("dashed"), S.month(F.concat(t, F.lit("15"))).alias("day"))
    return parsed.groupBy("ym", "month", "dashed", "day").agg(F.count(F.lit(1)).alias("n"))


@query("pr07_legacy_year", f"""
SELECT seq, line, part, TRY_CAST({T} AS BIGINT) AS year, CAST(2020 AS BIGINT) AS absent FROM cells_lineitem""")
def pr07(spark, sf):
    return V.cells_lineitem(spark, sf).select(
        "seq", "line", "part", S.legacy_year("`@time`").alias("year"),
        S.legacy_year(F.lit(None).cast("string")).alias("absent"),
    )


@query("pr08_labels", """
SELECT c.seq, COALESCE(k.name, '') AS region_name FROM cells_customer c
LEFT JOIN (SELECT code, name FROM classes WHERE level = '2' AND parent_code <> 'R0') k ON c."@area" = k.code""")
def pr08(spark, sf):
    known = V.classes(spark, sf).filter("level = '2' AND parent_code <> 'R0'")
    return labels.with_label(V.cells_customer(spark, sf), known, "area", "@area", "region_name").select("seq", "region_name")


@query("pr09_renamed", """
SELECT seq, "@cat01" AS category, "@cat02" AS subcategory, "@cat03" AS detail, "@area" AS region_code, "@time" AS year FROM cells_orders""")
def pr09(spark, sf):
    return domains.renamed(V.cells_orders(spark, sf)).select("seq", "category", "subcategory", "detail", "region_code", "year")


@query("pr10_code_and_label", """
SELECT c.seq, c."@area" AS area_code, COALESCE(k.name, '') AS area_name FROM cells_orders c LEFT JOIN classes k ON c."@area" = k.code""")
def pr10(spark, sf):
    df = labels.with_label(V.cells_orders(spark, sf), V.classes(spark, sf), "area", "@area", "area_name")
    return df.select("seq", F.col("`@area`").alias("area_code"), "area_name")


@query("pr11_lineage", """
SELECT seq, '3.0' AS source_api_version, 'getStatsData' AS endpoint, TIMESTAMP '2024-01-01 00:00:00' AS ingestion_timestamp FROM cells_customer""")
def pr11(spark, sf):
    df = domains.with_lineage(V.cells_customer(spark, sf), "3.0", "getStatsData", V.STAMP)
    return df.select("seq", "source_api_version", "endpoint", F.col("ingestion_timestamp").cast("timestamp_ntz").alias("ingestion_timestamp"))


@query("pr12_normalised_name", r"""
SELECT doc_id, CASE WHEN s = '' THEN 'column' ELSE s END AS name FROM (
  SELECT doc_id, trim(regexp_replace(lower(regexp_replace(regexp_replace(text, '[^\x00-\x7F]+', '', 'g'), '[^a-zA-Z0-9_]', '_', 'g')), '_+', '_', 'g'), '_') AS s
  FROM documents)""")
def pr12(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", S.normalised_name("text").alias("name"))


_SAMPLES = (("text", "text"), ("n_chars", "CAST(n_chars AS VARCHAR)"), ("ratio", "CAST(doc_id AS VARCHAR) || '.5'"), ("day", "'2020-01-01 ' || source"))


@query("pr13_column_types", " UNION ALL ".join(f"""
SELECT '{n}' AS column_name, CASE max(r) WHEN 3 THEN 'STRING' WHEN 2 THEN 'TIMESTAMP' WHEN 1 THEN 'DOUBLE' ELSE 'INT' END AS type FROM (
  SELECT CASE WHEN regexp_matches(v, '^-?[0-9]+$') THEN 0 WHEN regexp_matches(v, '^-?[0-9]+[.][0-9]+$') THEN 1
              WHEN regexp_matches(v, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN 2 ELSE 3 END AS r
  FROM (SELECT {e} AS v FROM documents))""" for n, e in _SAMPLES))
def pr13(spark, sf):
    from tidycell.operators.profiles import column_types
    d = V.table(spark, sf, "documents").select(
        "text", F.col("n_chars").cast("string").alias("n_chars"),
        F.concat(F.col("doc_id").cast("string"), F.lit(".5")).alias("ratio"),
        F.concat(F.lit("2020-01-01 "), "source").alias("day"),
    )
    return column_types(d)


_TITLE = "CASE {k} % 12 " + " ".join(
    f"WHEN {i} THEN '{t}'" for i, t in enumerate(
        ("国勢調査 人口等基本集計", "労働力調査", "学校基本調査", "患者調査", "農林業センサス", "住宅着工統計", "自動車輸送統計",
         "商業動態統計", "介護サービス施設", "GDP 統計", "気象観測")
    )
) + " ELSE '人口 と 労働 と 教育' END"
_DOMAIN_CASE = "CASE " + " ".join(
    f"WHEN regexp_matches(lower(title), '{'|'.join(terms)}') THEN '{d}'" for d, terms in domains.DOMAIN_TERMS
) + " ELSE 'generic' END"


@query("pr14_domain_of_title", f"""
SELECT domain, count(*) AS n, min(seq) AS first_seq FROM (
  SELECT seq, {_DOMAIN_CASE} AS domain FROM (SELECT o_orderkey AS seq, {_TITLE.replace('{k}', 'o_orderkey')} || ' ' || o_orderpriority AS title FROM orders)) GROUP BY domain""")
def pr14(spark, sf):
    titled = V.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("seq"),
        F.concat(F.expr(_TITLE.replace("{k}", "o_orderkey")), F.lit(" "), "o_orderpriority").alias("title"),
    )
    return titled.groupBy(domains.infer_domain(F.col("title")).alias("domain")).agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq")
    )


@query("pr14_rule_table", f"""
SELECT domain, count(*) AS n, min(seq) AS first_seq FROM (
  SELECT seq, {_DOMAIN_CASE} AS domain FROM (SELECT o_orderkey AS seq, {_TITLE.replace('{k}', 'o_orderkey')} || ' ' || o_orderpriority AS title FROM orders)) GROUP BY domain""")
def pr14_rules(spark, sf):
    """The same domains from a table of rules."""
    titled = V.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("seq"), F.concat(F.expr(_TITLE.replace("{k}", "o_orderkey")), F.lit(" "), "o_orderpriority").alias("title"))
    found = rules.categorised(titled, rules.rule_table(spark, domains.DOMAIN_TERMS), "title", "domain", "generic")
    return found.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))


@query("pr15_schema_by_domain", """
SELECT domain, CAST(columns AS INTEGER) AS columns, partitions, count(*) AS datasets FROM (
  SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'construction' WHEN 'AUTOMOBILE' THEN 'transport' WHEN 'HOUSEHOLD' THEN 'population' ELSE 'generic' END AS domain,
         CASE c_mktsegment WHEN 'BUILDING' THEN 11 WHEN 'AUTOMOBILE' THEN 10 WHEN 'HOUSEHOLD' THEN 9 ELSE 8 END AS columns,
         CASE WHEN c_mktsegment IN ('BUILDING', 'AUTOMOBILE', 'HOUSEHOLD') THEN 'year,region_code' ELSE 'year' END AS partitions
  FROM customer) GROUP BY ALL""")
def pr15(spark, sf):
    names = {"BUILDING": "construction", "AUTOMOBILE": "transport", "HOUSEHOLD": "population", "MACHINERY": "weather", "FURNITURE": ""}
    seg = F.col("c_mktsegment")
    pick = lambda f: F.coalesce(*(F.when(seg == s, F.lit(f(d))) for s, d in names.items()))
    return V.table(spark, sf, "customer").groupBy(
        pick(schemas.resolve).alias("domain"), pick(lambda d: len(schemas.columns(d))).alias("columns"),
        pick(lambda d: ",".join(schemas.partition_columns(d))).alias("partitions"),
    ).agg(F.count(F.lit(1)).alias("datasets"))


@query("pr16_string_or_object", """
SELECT p_partkey, p_name AS title, CASE WHEN p_size > 25 THEN p_type ELSE 'N/A' END AS category FROM part""")
def pr16(spark, sf):
    p = V.table(spark, sf, "part").withColumn("doc", F.when(
        F.col("p_size") > 25,
        F.to_json(F.struct(F.struct(F.col("p_name").alias("$"), F.lit("1").alias("@no")).alias("TITLE"), F.col("p_type").alias("CAT"))),
    ).otherwise(F.to_json(F.struct(F.col("p_name").alias("TITLE")))))
    field = lambda n: F.get_json_object("doc", f"$.{n}")
    return p.select("p_partkey", S.string_or_object(field("TITLE")).alias("title"), S.string_or_object(field("CAT"), "N/A").alias("category"))


# --- metadata documents, one per part ------------------------------------------------------

def part_metadata(spark, sf):
    """A metadata document per part: ``cat01`` with p_size codes, ``cat02`` with one (a lone object), ``time`` with twelve."""
    p = V.spread(V.table(spark, sf, "part"))
    member = lambda code, name, **more: F.struct(code.alias("@code"), name.alias("@name"), *(v.alias(f"@{k}") for k, v in more.items()))
    sizes = F.transform(F.sequence(F.lit(1), F.col("p_size")), lambda i: member(
        F.lpad(i.cast("string"), 3, "0"), F.concat(F.lit("size "), i.cast("string")), level=F.lit("1"), parentCode=F.lit("000")))
    years = F.transform(F.sequence(F.lit(2001), F.lit(2012)), lambda y: member(
        F.concat(y.cast("string"), F.lit("000000")), F.concat(y.cast("string"), F.lit("年"))))
    obj = lambda i, n, m: F.to_json(F.struct(F.lit(i).alias("@id"), F.lit(n).alias("@name"), m.alias("CLASS")))
    objs = F.concat(
        F.lit("["), obj("cat01", "Size", sizes), F.lit(","), obj("cat02", "Brand", member(F.col("p_brand"), F.col("p_name"))),
        F.lit(","), obj("time", "時間軸", years), F.lit("]"))
    info = F.to_json(F.struct(
        F.lpad(F.col("p_partkey").cast("string"), 10, "0").alias("@id"),
        F.struct(F.lit("00200").alias("@code"), F.col("p_type").alias("$")).alias("STAT_NAME"),
        F.struct(F.col("p_name").alias("$")).alias("TITLE"), F.col("p_brand").alias("MAIN_CATEGORY"),
        F.when(F.col("p_size") > 40, F.lit(250000)).alias("OVERALL_TOTAL_NUMBER"),
        F.struct(F.col("p_type").alias("TABULATION_CATEGORY")).alias("STATISTICS_NAME_SPEC"),
    ))
    doc = F.concat(F.lit('{"GET_META_INFO":{"METADATA_INF":{"TABLE_INF":'), info, F.lit(',"CLASS_INF":{"CLASS_OBJ":'), objs, F.lit("}}}}"))
    return p.select(F.lpad(F.col("p_partkey").cast("string"), 10, "0").alias("dataset_id"), "p_size", doc.alias("value"))


view("part_classes", """
SELECT dataset_id, 0 AS category_pos, CAST(i - 1 AS INTEGER) AS code_pos, 'cat01' AS category_id, 'Size' AS category_name, CAST(p_size AS INTEGER) AS category_count,
       lpad(CAST(i AS VARCHAR), 3, '0') AS code, 'size ' || i AS name, '1' AS level, '000' AS parent_code, '' AS unit
FROM (SELECT lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS dataset_id, p_size, unnest(range(1, p_size + 1)) AS i FROM part)
UNION ALL SELECT lpad(CAST(p_partkey AS VARCHAR), 10, '0'), 1, 0, 'cat02', 'Brand', 1, p_brand, p_name, '', '', '' FROM part
UNION ALL SELECT lpad(CAST(p_partkey AS VARCHAR), 10, '0'), 2, CAST(y - 2001 AS INTEGER), 'time', '時間軸', 12, y || '000000', y || '年', '', '', ''
FROM part, (SELECT unnest(range(2001, 2013)) AS y)""")


@query("pr17_table_info", """
SELECT lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS "datasetId", '00200' AS "statsCode", p_type AS "STAT_NAME", p_name AS "TITLE", p_brand AS "MAIN_CATEGORY",
       CASE WHEN p_size > 40 THEN '250000' ELSE 'N/A' END AS "OVERALL_TOTAL_NUMBER", p_type AS "TABULATION_CATEGORY",
       'N/A' AS "TABULATION_SUB_CATEGORY1", 'N/A' AS "TABULATION_SUB_CATEGORY2", 'N/A' AS "TABULATION_SUB_CATEGORY3",
       'N/A' AS "TABULATION_SUB_CATEGORY4", 'N/A' AS "TABULATION_SUB_CATEGORY5", 'N/A' AS "limit", 'N/A' AS "updatedDate",
       'N/A' AS "SURVEY_YEARS", 'N/A' AS "OPEN_YEARS", 'N/A' AS "SUB_CATEGORY", 'N/A' AS "table_updated",
       '{"TABULATION_CATEGORY":"' || p_type || '"}' AS "STATISTICS_NAME_SPEC", 'N/A' AS "GOV_ORG", 'N/A' AS "STATISTICS_NAME",
       'N/A' AS "CYCLE", 'N/A' AS "COLLECT_AREA", 'N/A' AS "DESCRIPTION" FROM part""")
def pr17(spark, sf):
    # updatedDate and UPDATED_DATE differ by case only, which SQL engines do not tell apart.
    info = wire.table_info(part_metadata(spark, sf))
    return info.toDF(*("table_updated" if c == "UPDATED_DATE" else c for c in info.columns))


def _totals(spark, sf):
    docs = part_metadata(spark, sf)
    sized = wire.category_sizes(docs, keep=("dataset_id", "value"))
    info = wire.table_info(sized, keep=("dataset_id", "sizes"))
    stated = F.col("OVERALL_TOTAL_NUMBER").try_cast("bigint")
    return info.select("dataset_id", M.record_total(stated, F.col("sizes")).alias("total"))


_TOTAL = "SELECT lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS dataset_id, CAST(CASE WHEN p_size > 40 THEN 250000 ELSE p_size * 12 END AS BIGINT) AS total FROM part"


@query("pr18_record_total", _TOTAL)
def pr18(spark, sf):
    return _totals(spark, sf)


@query("pr19_requires_filtering", f"SELECT dataset_id, total >= 100000 AS requires_filtering FROM ({_TOTAL})")
def pr19(spark, sf):
    return _totals(spark, sf).select("dataset_id", M.requires_filtering(F.col("total")).alias("requires_filtering"))


@query("pr20_grouped_digits", "SELECT o_orderkey, format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) AS total FROM orders")
def pr20(spark, sf):
    return V.table(spark, sf, "orders").select("o_orderkey", S.grouped_digits(F.floor("o_totalprice").cast("bigint")).alias("total"))


@query("pr21_table_link", """
SELECT c_custkey, 'https://example.org/dbview?sid=' || NULLIF(regexp_replace(c_name, '[^0-9]', '', 'g'), '') AS link,
       'https://example.org/dbview?sid=' || NULLIF(regexp_replace(c_mktsegment, '[^0-9]', '', 'g'), '') AS no_link FROM customer""")
def pr21(spark, sf):
    base = "https://example.org/dbview?sid="
    return V.table(spark, sf, "customer").select(
        "c_custkey", S.table_link("c_name", base).alias("link"), S.table_link("c_mktsegment", base).alias("no_link"))


@query("pr22_digits_only", """
SELECT p_partkey, COALESCE(CASE WHEN regexp_matches(code, '^[0-9]+$') THEN CAST(code AS INTEGER) END, -1) AS age
FROM (SELECT p_partkey, CASE WHEN p_size = 50 THEN 'T01' ELSE lpad(CAST(p_size AS VARCHAR), 3, '0') END AS code FROM part)""")
def pr22(spark, sf):
    code = F.when(F.col("p_size") == 50, "T01").otherwise(F.lpad(F.col("p_size").cast("string"), 3, "0"))
    return V.table(spark, sf, "part").select("p_partkey", F.coalesce(S.digits_only(code), F.lit(-1)).alias("age"))


@query("pr23_percent_of", """
SELECT l_orderkey, l_linenumber, l_partkey, 100 * (l_quantity / NULLIF(l_quantity - 1, 0)) AS percent FROM lineitem""")
def pr23(spark, sf):
    return V.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", S.percent_of(F.col("l_quantity"), F.col("l_quantity") - 1).alias("percent"))


# --- domain mappings -----------------------------------------------------------------------

def _domain_query(number, domain, cells, dataset_id=None):
    sql = V.sql_domain(domain, cells, dataset_id)

    @query(f"dm{number:02d}_{domain}", sql)
    def run(spark, sf):
        return V.bare(V.mapped(spark, sf, domain, cells, dataset_id))


@query("dm01_population", V.sql_domain("population", "(SELECT c.*, k.name FROM cells_customer c LEFT JOIN classes k ON c.\"@area\" = k.code)").replace("'' AS region_name", "COALESCE(name, '') AS region_name"))
def dm01(spark, sf):
    return V.bare(V.mapped(spark, sf, "population", "cells_customer", codes=V.classes(spark, sf)))


for _n, _d, _c, _i in (
    (2, "economy", "cells_orders", None), (3, "generic", "cells_orders", "G1"), (4, "labor", "cells_lineitem", None),
    (5, "education", "cells_customer", "ED"), (6, "health", "cells_customer", None), (7, "agriculture", "cells_orders", None),
    (8, "construction", "cells_lineitem", "CO"), (9, "transport", "cells_lineitem", None), (10, "trade", "cells_orders", "TR"),
    (11, "social_welfare", "cells_customer", None),
):
    _domain_query(_n, _d, _c, _i)


_OLD = f"""SELECT '{{kind}}' AS kind, 'OLD' AS stats_data_id, {V.sql_measure(chr(34) + "$" + chr(34), "null")} AS value, "@unit" AS unit,
  TRY_CAST("@time" AS BIGINT) AS year, {{region}} AS region_code, {{dims}} AS dims FROM cells_customer"""


@query("dm12_legacy", " UNION ALL ".join((
    _OLD.format(kind="population", region='"@cat01"', dims="""'region_name=,category=' || "@cat02\""""),
    _OLD.format(kind="economy", region='"@area"', dims="""'quarter=1,indicator=' || "@cat01\""""),
    _OLD.format(kind="education", region='"@area"', dims="""'school_type=' || "@cat01" || ',metric=' || "@cat02\""""),
    _OLD.format(kind="other", region='"@area"', dims="""'category=' || "@cat01\""""),
)))
def dm12(spark, sf):
    cells, parts = V.cells_customer(spark, sf), []
    for kind in ("population", "economy", "education", "other"):
        old = domains.to_legacy(cells, kind, "OLD", V.STAMP)
        extra = [c for c in old.columns if c not in ("stats_data_id", "value", "unit", "year", "region_code", "updated_at")]
        dims = F.concat_ws(",", *(F.concat(F.lit(f"{c}="), F.col(c)) for c in extra))
        parts.append(old.select(F.lit(kind).alias("kind"), "stats_data_id", "value", "unit", "year", "region_code", dims.alias("dims")))
    return joins.union_tables(parts)


@query("d04_period_bounds", """
SELECT seq, CASE WHEN regexp_matches(t, '^[0-9]{10}$') THEN CAST(substr(t, 7, 2) AS INTEGER) ELSE 0 END AS period_from,
       CASE WHEN regexp_matches(t, '^[0-9]{10}$') THEN CAST(substr(t, 9, 2) AS INTEGER) ELSE 0 END AS period_to
FROM (SELECT o_orderkey AS seq, strftime(o_orderdate, '%Y') || '00' || lpad(CAST(quarter(o_orderdate) * 3 - 2 AS VARCHAR), 2, '0') || CASE WHEN o_orderstatus = 'P' THEN '' ELSE lpad(CAST(quarter(o_orderdate) * 3 AS VARCHAR), 2, '0') END AS t FROM orders)""")
def d04(spark, sf):
    q = F.quarter("o_orderdate")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    t = F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("00"), two(q * 3 - 2), F.when(F.col("o_orderstatus") == "P", "").otherwise(two(q * 3)))
    first, last = S.period_bounds(F.col("t"))
    return V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), t.alias("t")).select(
        "seq", F.coalesce(first, F.lit(0)).alias("period_from"), F.coalesce(last, F.lit(0)).alias("period_to"))
