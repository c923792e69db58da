"""Catalogue search (SR-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidycell.operators import search as R
from tidycell.session import scratch
from workloads import views as V
from workloads.registry import query, view

QUERIES = (
    "the and tion", "eau  ou ère", "src1 en", "Survey de src7", "zzzz qqqq", "a", "Thnt heention ion", "und der src3 fr", "ón que la es", "long text",
)

view("words", "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in enumerate(QUERIES)) + ") AS q(query_id, query)")
view("search_queries", r"""
SELECT query_id, query, list_filter(string_split_regex(query, '\s+'), lambda w: length(w) > 1) AS tokens,
       len(list_filter(string_split_regex(query, '\s+'), lambda w: length(w) > 1)) AS k FROM words""")

_AGE = "date_diff('day', TRY_CAST(open_date AS DATE), DATE '2024-06-30')"
_READABLE = "regexp_matches(open_date, '^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$')"
FRESH = f"""CASE WHEN NOT {_READABLE} THEN NULL WHEN {_AGE} <= 365 THEN 1.0::DOUBLE WHEN {_AGE} <= 1825 THEN 1.0::DOUBLE - ({_AGE} - 365)::DOUBLE / 1460 * 0.5::DOUBLE
 WHEN {_AGE} <= 3650 THEN 0.5::DOUBLE - ({_AGE} - 1825)::DOUBLE / 1825 * 0.5::DOUBLE ELSE 0.0::DOUBLE END"""

_HIT = "len(list_filter(tokens, lambda t: contains({c}, t)))"
view("hits", f"""
SELECT query_id, query, tokens, k, id, position, title, {_HIT.replace('{c}', 'title')} AS t,
       {_HIT.replace('{c}', "(statistics_name || ' ' || main_category || ' ' || sub_category)")} AS c, {_HIT.replace('{c}', 'description')} AS d,
       CASE WHEN open_date = '' THEN 0 ELSE COALESCE(0.15::DOUBLE * ({FRESH}), 0.075::DOUBLE) END
       + CASE WHEN regexp_matches(gov_org, '総務省|警察庁|国土交通省|厚生労働省|内閣府') THEN 0.1::DOUBLE ELSE 0 END
       + 0.05::DOUBLE * (((statistics_name <> '')::INT + (description <> '')::INT + (title_spec <> '')::INT) / 3) AS standing
FROM catalogue, search_queries""")
view("basic", """
SELECT query_id, query, tokens, id, position, title,
       least(round(COALESCE(0.25::DOUBLE * (t / NULLIF(k, 0)), 0) + COALESCE(0.15::DOUBLE * (c / NULLIF(k, 0)), 0) + COALESCE(0.1::DOUBLE * (d / NULLIF(k, 0)), 0) + standing, 9), 1.0::DOUBLE) AS basic_score
FROM hits WHERE k = 0 OR t + c + d > 0""")


def _queries(spark):
    return spark.createDataFrame(list(enumerate(QUERIES)), "query_id int, query string")


@query("sr01_tokens", r"""
SELECT conv_id, turn, len(list_filter(string_split_regex(trim(text), '\s+'), lambda w: length(w) > 1)) AS tokens,
       array_to_string(list_filter(string_split_regex(trim(text), '\s+'), lambda w: length(w) > 1), ' ') AS joined FROM conversations""")
def sr01(spark, sf):
    toks = R.tokens(F.col("text"))
    return V.table(spark, sf, "conversations").select("conv_id", "turn", F.size(toks).cast("bigint").alias("tokens"), F.array_join(toks, " ").alias("joined"))


# A small dictionary of the kind a user supplies: (term, suggested, reason).
TERMS = (
    ("red", "crimson", "formal term"), ("small", "compact", "formal term"), ("large", "large scale", "formal term"),
    ("ring", "ring seal", "formal term"), ("widget", "device", "formal term"), ("blue", "azure", "formal term"), ("bolt", "fastener", "formal term"),
)
view("dictionary", "SELECT * FROM (VALUES " + ", ".join(str(t) for t in TERMS) + ") AS t(term, suggested, reason)")


def _dictionary(spark):
    return spark.createDataFrame(list(TERMS), "term string, suggested string, reason string")


@query("sr02_suggestions", r"""
SELECT DISTINCT query_id, term, suggested, reason FROM (SELECT p_partkey AS query_id, p_name || CASE WHEN p_size > 40 THEN ' device' ELSE '' END AS query, unnest(string_split(p_name || CASE WHEN p_size > 40 THEN ' device' ELSE '' END, ' ')) AS word FROM part)
JOIN dictionary ON word = term WHERE NOT contains(query, suggested)""")
def sr02(spark, sf):
    queries = V.table(spark, sf, "part").select(
        F.col("p_partkey").alias("query_id"), F.concat("p_name", F.when(F.col("p_size") > 40, " device").otherwise("")).alias("query"))
    return R.suggestions(queries, _dictionary(spark)).select("query_id", "term", "suggested", "reason")


@query("sr03_apply_replacements", r"""
SELECT p_partkey, array_to_string(list_transform(list_filter(string_split_regex(p_name, '\s+'), lambda w: w <> ''), lambda w: CASE w WHEN 'red' THEN 'crimson' WHEN 'widget' THEN 'device' ELSE w END), ' ') AS query FROM part""")
def sr03(spark, sf):
    spaced = F.regexp_replace("p_name", " ", "   ")
    return V.table(spark, sf, "part").select("p_partkey", R.apply_replacements(spaced, {"red": "crimson", "widget": "device"}).alias("query"))


@query("sr03_accepted_per_query", r"""
SELECT p_partkey AS query_id, array_to_string(list_transform(list_filter(string_split_regex(p_name, '\s+'), lambda w: w <> ''),
       lambda w: CASE WHEN p_size % 2 = 0 AND w = 'red' THEN 'crimson' WHEN p_size % 3 = 0 AND w = 'widget' THEN 'device' ELSE w END), ' ') AS query FROM part""")
def sr03_accepted(spark, sf):
    """Each query accepts replacements of its own."""
    p = V.table(spark, sf, "part")
    one = lambda every, term, suggested: p.filter(F.col("p_size") % every == 0).select(F.col("p_partkey").alias("query_id"), F.lit(term).alias("term"), F.lit(suggested).alias("suggested"))
    accepted = one(2, "red", "crimson").unionByName(one(3, "widget", "device"))
    return R.apply_accepted(p.select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("query")), accepted)


@query("sr04_basic_score", "SELECT query_id, id, basic_score FROM basic WHERE len(tokens) > 0")
def sr04(spark, sf):
    return R.basic_scores(V.catalogue(spark, sf), _queries(spark), V.AS_OF).select("query_id", "id", "basic_score")


@query("sr04_given_pairs", f"""
SELECT id, query_id, least(round(COALESCE(0.25::DOUBLE * (t / NULLIF(k, 0)), 0) + COALESCE(0.15::DOUBLE * (c / NULLIF(k, 0)), 0) + COALESCE(0.1::DOUBLE * (d / NULLIF(k, 0)), 0) + standing, 9), 1.0::DOUBLE) AS basic_score
FROM hits WHERE query_id = position % {len(QUERIES)}""")
def sr04_given(spark, sf):
    """One query for every row, matching or not."""
    rows = V.catalogue(spark, sf).withColumn("query_id", (F.col("position") % len(QUERIES)).cast("int"))
    query = F.element_at(F.array(*map(F.lit, QUERIES)), F.col("query_id") + 1)
    return rows.select("id", "query_id", R.basic_score(query, V.AS_OF).alias("basic_score"))


@query("sr05_freshness", f"SELECT id, round({FRESH}, 9) AS freshness, round(CASE WHEN open_date = '' THEN 0 ELSE COALESCE(0.15::DOUBLE * ({FRESH}), 0.075::DOUBLE) END, 9) AS score FROM catalogue")
def sr05(spark, sf):
    d = F.col("open_date")
    return V.catalogue(spark, sf).select("id", F.round(R.freshness(d, V.AS_OF), 9).alias("freshness"), F.round(R.freshness_score(d, V.AS_OF), 9).alias("score"))


def metadata(spark, sf):
    """Metadata of each catalogue row: its size and two categories."""
    kind = lambda i, n, *values: F.struct(F.lit(i).alias("id"), F.lit(n).alias("name"), F.array(*values).alias("values"))
    return V.catalogue(spark, sf).select(
        "id", F.when(F.col("n_chars") % 5 != 0, F.col("n_chars")).alias("total_records"),
        F.array(kind("cat01", "Source", F.col("sub_category"), F.col("main_category")), kind("cat02", "Title", *(F.col(c) for c in ("title", "statistics_name", "main_category", "sub_category", "gov_org", "id")))).alias("categories"))


view("metadata", """
SELECT id, CASE WHEN n_chars % 5 <> 0 THEN n_chars END AS total_records, sub_category || ' ' || main_category AS text1,
       title || ' ' || statistics_name || ' ' || main_category || ' ' || sub_category || ' ' || gov_org || ' ' || id AS text2 FROM catalogue""")
MATCH = f"least(COALESCE(({_HIT.replace('{c}', 'text1')} + {_HIT.replace('{c}', 'text2')}) / NULLIF(len(tokens), 0), 0), 1.0)"
SIZE = "CASE WHEN total_records IS NULL THEN 0.5::DOUBLE WHEN total_records >= 10000 THEN 1.0 WHEN total_records >= 1000 THEN 0.9 WHEN total_records >= 100 THEN 0.7 WHEN total_records >= 10 THEN 0.5 ELSE 0.3 END"


@query("sr06_category_match", rf"""
SELECT id, {MATCH} AS score FROM (SELECT m.*, list_filter(string_split_regex('Survey src1 e', '\s+'), lambda w: length(w) > 1) AS tokens FROM metadata m)""")
def sr06(spark, sf):
    return metadata(spark, sf).select("id", R.category_match(F.lit("Survey src1 e"), F.col("categories")).alias("score"))


@query("sr07_size_score", f"SELECT id, CAST({SIZE} AS DOUBLE) AS score FROM metadata")
def sr07(spark, sf):
    return metadata(spark, sf).select("id", R.size_score(F.col("total_records")).alias("score"))


view("ranked", f"""
SELECT b.*, m.total_records, m.text1, m.text2, least(round(0.8::DOUBLE * basic_score + 0.15::DOUBLE * {MATCH} + 0.05::DOUBLE * {SIZE}, 9), 1.0::DOUBLE) AS score
FROM basic b JOIN metadata m ON b.id = m.id""")


@query("sr08_enhanced_score", "SELECT query_id, id, score FROM ranked WHERE len(tokens) > 0")
def sr08(spark, sf):
    basic = R.basic_scores(V.catalogue(spark, sf), _queries(spark), V.AS_OF)
    return basic.join(metadata(spark, sf), "id").select(
        "query_id", "id", R.enhanced_score(F.col("basic_score"), F.col("query"), F.col("categories"), F.col("total_records")).alias("score"))


view("top20", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY basic_score DESC, position) AS basic_rank FROM ranked) WHERE basic_rank <= 20""")


@query("sr09_rerank", """
SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, basic_rank) AS rank FROM top20) WHERE rank <= 5""")
def sr09(spark, sf):
    return R.search(V.catalogue(spark, sf), metadata(spark, sf), _queries(spark), V.AS_OF).select("query_id", "id", "score", "rank")


@query("sr04_indexed_score", "SELECT query_id, id, basic_score FROM basic WHERE len(tokens) > 0")
def sr04_indexed(spark, sf):
    """The scores from posting lists, without the catalogue."""
    index = scratch(spark, "index")
    R.build_index(V.catalogue(spark, sf), index)
    return R.indexed_scores(spark, index, _queries(spark), V.AS_OF).select("query_id", "id", "basic_score")


@query("sr09_indexed", """
SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, basic_rank) AS rank FROM top20) WHERE rank <= 5""")
def sr09_indexed(spark, sf):
    index = scratch(spark, "index")
    R.build_index(V.catalogue(spark, sf), index)
    found = R.search(V.catalogue(spark, sf), metadata(spark, sf), _queries(spark), V.AS_OF, index=index)
    return found.select("query_id", "id", "score", "rank")


@query("sr09_basic_only", "SELECT query_id, id, basic_score AS score, CAST(basic_rank AS INTEGER) AS rank FROM top20 WHERE basic_rank <= 10")
def sr09_basic(spark, sf):
    found = R.search(V.catalogue(spark, sf), metadata(spark, sf), _queries(spark), V.AS_OF, results=10, method="basic")
    return found.select("query_id", "id", "score", "rank")


_LONG_WORDS = "[a-z]{9,}"


@query("sr09_many_queries", f"""
WITH asked AS (SELECT conv_id * 1000 + turn AS query_id, unnest(list_distinct(regexp_extract_all(text, '{_LONG_WORDS}'))) AS token, len(regexp_extract_all(text, '{_LONG_WORDS}')) AS k,
       regexp_extract_all(text, '{_LONG_WORDS}') AS tokens FROM conversations),
     texts AS (SELECT id, position, title, statistics_name || ' ' || main_category || ' ' || sub_category AS names, description FROM catalogue),
     found AS (SELECT token, id, position, contains(title, token)::INT AS t, contains(names, token)::INT AS c, contains(description, token)::INT AS d
               FROM (SELECT DISTINCT token FROM asked), texts WHERE contains(title, token) OR contains(names, token) OR contains(description, token)),
     counted AS (SELECT query_id, id, position, any_value(k) AS k, sum(t * len(list_filter(tokens, lambda x: x = token))) AS t, sum(c * len(list_filter(tokens, lambda x: x = token))) AS c,
                 sum(d * len(list_filter(tokens, lambda x: x = token))) AS d FROM asked JOIN found USING (token) GROUP BY ALL),
     scored AS (SELECT query_id, id, position, least(round(0.25::DOUBLE * (t / k) + 0.15::DOUBLE * (c / k) + 0.1::DOUBLE * (d / k) + standing, 9), 1.0::DOUBLE) AS score
                FROM counted JOIN (SELECT id, any_value(standing) AS standing FROM hits WHERE query_id = 0 GROUP BY id) USING (id))
SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, position) AS rank FROM scored) WHERE rank <= 10""")
def sr09_many(spark, sf):
    """The long words of every turn of every conversation as a query; turns without any have nothing to rank here."""
    asked = F.array_join(F.regexp_extract_all("text", F.lit(_LONG_WORDS), F.lit(0)), " ")
    queries = V.table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), asked.alias("query"))
    found = R.search(V.catalogue(spark, sf), metadata(spark, sf), queries.filter("query <> ''"), V.AS_OF, results=10, method="basic")
    return found.select("query_id", "id", "score", "rank")


@query("sr10_enriched_results", """
SELECT id, 'cat01:Source:2:' || sub_category || '|' || main_category AS first_category,
       'cat02:Title:6:' || title || '|' || statistics_name || '|' || main_category || '|' || sub_category || '|' || gov_org AS second_category FROM catalogue""")
def sr10(spark, sf):
    rich = metadata(spark, sf).select("id", R.enriched(F.col("categories")).alias("c"))
    line = lambda i: F.concat_ws(":", F.col("c")[i]["id"], F.col("c")[i]["name"], F.col("c")[i]["count"], F.array_join(F.col("c")[i]["sample"], "|"))
    return rich.select("id", line(0).alias("first_category"), line(1).alias("second_category"))


@query("sr11_listing", "SELECT id, title, gov_org, survey_date, open_date, updated_date FROM catalogue ORDER BY position LIMIT 10")
def sr11(spark, sf):
    return R.listing(V.catalogue(spark, sf))
