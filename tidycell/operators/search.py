"""Catalogue search (SR-01 .. SR-11, WN-02).

Queries are a table ``(query_id, query)``, so planning takes the same time for one and for a million.
Their distinct tokens meet the catalogue's distinct words by an equi-join on fragments (a word that
contains a token contains its first ``LONG`` characters, or ``GRAM`` in an index) and are checked with ``contains``; the rows with
such words are then counted per query, and top lists are cut per task before their shuffle.  A search for many tokens counts
only rows that can be among a query's best.  A few tokens are looked
for in the scan itself, and a catalogue that is searched again and again is given an index of posting lists.

The catalogue has ``position, id, title, statistics_name, main_category,
sub_category, description, gov_org, open_date, title_spec``; ``(id, position)`` names a row.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidycell.session import scratch

# Score weights, trusted publishers, freshness and size curves.
W_TITLE, W_CATEGORY, W_DESCRIPTION = 0.25, 0.15, 0.10
W_FRESH, W_UNREADABLE_DATE, W_TRUSTED, W_COMPLETE = 0.15, 0.075, 0.10, 0.05
W_BASIC, W_CLASSES, W_SIZE = 0.80, 0.15, 0.05
TRUSTED = ("総務省", "警察庁", "国土交通省", "厚生労働省", "内閣府")
DAYS_NEW, DAYS_RECENT, DAYS_OLD = 365, 1825, 3650
SIZE_STEPS = ((10000, 1.0), (1000, 0.9), (100, 0.7), (10, 0.5))
SIZE_SMALLEST, SIZE_UNKNOWN = 0.3, 0.5
STAGE_ONE, RESULTS, LISTED, SAMPLE = 20, 5, 10, 5

GRAM = 4
#: Fragments that are cut from words when they are needed are longer, so that few tokens share one: the words of a common
#: fragment would meet all tokens that begin with it, and their number grows with the tokens and with the words.
LONG = 12
#: Tokens have so many characters at least.
LEAST = 2
#: So many different tokens are looked for in the scan of the catalogue itself.
FEW = 256
#: Folders of an index; a search reads those its tokens' fragments and words fall into.
BUCKETS = 256
#: What an index keeps of a row for its score.
KEPT = ("open_date", "trusted", "complete")
#: Lists of an index have so many rows on average, at most; a word that more rows have has several lists.
LIST = 1_000_000
SPACES = r"[\s　]+"
DIGITS = 9
#: Bounds of scores are kept this far from them: more than rounding to ``DIGITS`` places moves a score.
SLACK = 1e-8
#: Sets of tokens are compared by their bits in so many numbers of 64, by field.
SIGNS = {"_t": 4, "_c": 1, "_d": 8}


def words(query: Column) -> Column:
    """The words of a query."""
    return F.filter(F.split(query, SPACES), lambda w: w != "")


def tokens(query: Column) -> Column:
    """SR-01: the words longer than one character."""
    return F.filter(words(query), lambda w: F.length(w) > 1)


def suggestions(queries: DataFrame, dictionary: DataFrame) -> DataFrame:
    """SR-02: dictionary entries for words of a query whose suggestion is not already part of it."""
    each = queries.select("query_id", "query", F.explode(F.array_distinct(words(F.col("query")))).alias("term"))
    found = each.join(dictionary, "term")
    return found.filter(~F.col("query").contains(F.col("suggested")))


def apply_replacements(query: Column, accepted: dict[str, str]) -> Column:
    """SR-03: replace accepted words; words are joined by single spaces."""
    if not accepted:
        return F.array_join(words(query), " ")
    pairs = F.create_map(*(F.lit(x) for pair in accepted.items() for x in pair))
    return F.array_join(F.transform(words(query), lambda w: F.coalesce(F.try_element_at(pairs, w), w)), " ")


def apply_accepted(queries: DataFrame, accepted: DataFrame) -> DataFrame:
    """SR-03 with each query's own accepted words, ``(query_id, term, suggested)``.

    Of several suggestions for a word the first by code point counts; a query without words becomes empty.
    """
    each = queries.select("query_id", F.posexplode_outer(words(F.col("query"))).alias("at", "term"))
    chosen = accepted.groupBy("query_id", "term").agg(F.min("suggested").alias("suggested"))
    word = F.struct("at", F.coalesce("suggested", "term").alias("word"))
    put = each.join(chosen, ["query_id", "term"], "left").groupBy("query_id").agg(F.sort_array(F.collect_list(word)).alias("w"))
    return put.select("query_id", F.array_join(F.col("w")["word"], " ").alias("query"))


def freshness(open_date: Column, as_of: dt.date) -> Column:
    """SR-05: 1 for a year, then falling to 0 at ten years; NULL for an unreadable date."""
    day = F.when(open_date.rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), open_date.try_cast("date"))
    age = F.datediff(F.lit(as_of), day)
    return (
        F.when(age <= DAYS_NEW, F.lit(1.0))
        .when(age <= DAYS_RECENT, 1.0 - (age - DAYS_NEW) / (DAYS_RECENT - DAYS_NEW) * 0.5)
        .when(age <= DAYS_OLD, 0.5 - (age - DAYS_RECENT) / (DAYS_OLD - DAYS_RECENT) * 0.5)
        .when(age > DAYS_OLD, F.lit(0.0))
    )


def freshness_score(open_date: Column, as_of: dt.date) -> Column:
    """SR-05 weighted: nothing for a blank date, a fixed middle for an unreadable one."""
    blank = F.coalesce(open_date, F.lit("")) == ""
    return F.when(blank, F.lit(0.0)).otherwise(
        F.coalesce(W_FRESH * freshness(open_date, as_of), F.lit(W_UNREADABLE_DATE))
    )


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _merits() -> tuple[Column, Column]:
    """What a row's publisher and its filled fields are worth."""
    trusted = reduce(lambda a, b: a | b, (_text("gov_org").contains(org) for org in TRUSTED))
    filled = reduce(
        lambda a, b: a + b,
        (F.when(_text(c) != "", 1).otherwise(0) for c in ("statistics_name", "description", "title_spec")),
    )
    return F.when(trusted, W_TRUSTED).otherwise(0.0), W_COMPLETE * (filled / 3)


def _standing(open_date: Column, trusted: Column, complete: Column, as_of: dt.date) -> Column:
    return freshness_score(open_date, as_of) + trusted + complete


def standing_score(as_of: dt.date) -> Column:
    """The parts of the basic score that do not depend on the query."""
    return _standing(F.col("open_date"), *_merits(), as_of)


def _texts() -> dict[str, Column]:
    """The searched texts of a catalogue row."""
    names = F.concat_ws(" ", _text("statistics_name"), _text("main_category"), _text("sub_category"))
    return {"_t": _text("title"), "_c": names, "_d": _text("description")}


def _basic(t: Column, c: Column, d: Column, k: Column, standing: Column) -> Column:
    part = lambda weight, n: F.coalesce(weight * F.try_divide(n, k), F.lit(0.0))
    score = part(W_TITLE, t) + part(W_CATEGORY, c) + part(W_DESCRIPTION, d) + standing
    return F.least(F.round(score, DIGITS), F.lit(1.0))


def basic_score(query: Column, as_of: dt.date) -> Column:
    """SR-04 of a catalogue row and a query beside it, whether they match or not."""
    toks = tokens(query)
    hits = lambda text: F.size(F.filter(toks, lambda t: F.contains(text, t)))
    return _basic(*map(hits, _texts().values()), F.size(toks), standing_score(as_of))


def _held(catalogue: DataFrame, *more: Column, least: int = 1) -> DataFrame:
    """(id, position, ..., field, word): the distinct words of every text that have ``least`` characters at least."""
    runs = lambda text: F.regexp_extract_all(text, F.lit(rf"[^\s　]{{{least},}}"), F.lit(0))
    fields = [
        catalogue.select("id", "position", *more, F.lit(n).alias("field"), F.explode(F.array_distinct(runs(c))).alias("word"))
        for n, c in _texts().items()]
    return reduce(lambda a, b: a.union(b), fields)


def _lengths(asked: DataFrame) -> list[int]:
    """How long the fragments are that are asked for, of ``LEAST`` to ``GRAM`` or ``LONG``."""
    return sorted(r.n for r in asked.select(F.length("fragment").alias("n")).distinct().collect())


def _fragments(words: DataFrame, lengths: list[int]) -> DataFrame:
    """(word, fragment): the runs of so many characters of every word."""
    runs = [F.regexp_extract_all("word", F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in lengths]
    return words.select("word", F.explode(F.array_distinct(F.flatten(F.array(*runs).cast("array<array<string>>")))).alias("fragment"))


def _asked(queries: DataFrame, most: int = GRAM) -> DataFrame:
    asked = queries.select(F.explode(tokens(F.col("query"))).alias("token")).distinct()
    return asked.withColumn("fragment", F.substring("token", 1, most))


def _few(asked: DataFrame) -> list[str] | None:
    """The different tokens, if they are ``FEW`` at most."""
    few = [r.token for r in asked.select("token").limit(FEW + 1).collect()]
    return sorted(few) if len(few) <= FEW else None


def _found(catalogue: DataFrame, asked: DataFrame) -> DataFrame:
    """(token, id, position, field), also several times: the tokens in the words of the catalogue.

    A word has a token's characters at least, so shorter ones are left out before anything is shuffled. The others are
    written once, as they are read twice.
    """
    spark, lengths = catalogue.sparkSession, _lengths(asked)
    path = scratch(spark, "search-held")
    _held(catalogue, least=lengths[0]).write.parquet(path)
    held = spark.read.parquet(path)
    digest = F.xxhash64("fragment").alias("fragment")  # shorter than the text, which is compared by contains
    cut = _fragments(held.select("word").distinct(), lengths).select("word", digest)
    fit = cut.join(asked.select("token", digest), "fragment").filter(F.contains("word", "token")).select("token", "word")
    return held.join(fit, "word").select("token", "id", "position", "field")


def matches(catalogue: DataFrame, queries: DataFrame) -> DataFrame:
    """(token, id, position, field): where in the catalogue the tokens of the queries occur.

    Up to ``FEW`` different tokens are looked for in the texts as these are read; nothing but the hits is shuffled.
    Beyond that, as a token has no white space and so lies within one word of a text, tokens are looked for in the
    distinct words of the catalogue, and only the rows of the words that have one are read off.
    """
    asked = _asked(queries, LONG)
    few = _few(asked)
    if few is None:
        return _found(catalogue, asked).distinct()
    known = F.array(*map(F.lit, few)).cast("array<string>")

    def hits_in(name: str, text: Column) -> Column:
        return F.transform(F.filter(known, lambda t: F.contains(text, t)), lambda t: F.struct(F.lit(name).alias("field"), t.alias("token")))

    hits = [hits_in(n, c) for n, c in _texts().items()]
    found = catalogue.select("id", "position", F.explode(F.flatten(F.array(*hits))).alias("h"))
    return found.select("h.token", "id", "position", "h.field").distinct()


def _runs(words: DataFrame) -> DataFrame:
    """(word, at): the places in every word where a run of ``GRAM`` characters begins, fewer at the end, ``LEAST`` at least.

    Of equal runs the first counts.  The beginnings of the runs are the fragments, so an index holds one row for a place in
    a word and not one for each length.
    """
    runs = F.regexp_extract_all("word", F.lit(f"(?s)(?=(.{{{LEAST},{GRAM}}}))"), F.lit(1))
    places = F.transform(F.array_distinct("runs"), lambda r: F.array_position(F.col("runs"), r).cast("int"))
    return words.select("word", runs.alias("runs")).select("word", F.explode(places).alias("at"))


def _bucket(c: str | Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")


def _row_number(catalogue: DataFrame, whole: list[Column]) -> Column:
    """A number that no two different rows of a catalogue share: their position, or else a digest of ``whole``."""
    digests = [F.xxhash64(*whole, *(c.isNull() for c in whole), F.lit(i)) for i in range(9)]
    plain = [F.col("position").cast("bigint")] if catalogue.schema["position"].dataType.typeName() in ("integer", "long") else []
    rows = catalogue.select(F.struct(*whole).alias("r"), *(c.alias(f"n{i}") for i, c in enumerate([*plain, *digests]))).distinct()
    for i, number in enumerate([*plain, *digests]):
        if rows.groupBy(f"n{i}").count().where(f"count > 1 OR n{i} IS NULL").isEmpty():
            return number
    raise ValueError("rows of the catalogue cannot be told apart")


def build_index(catalogue: DataFrame, path: str) -> None:
    """SR-04: posting lists of a catalogue, kept as three tables below ``path``.

    ``words`` has the distinct words by what follows each of their characters, ``postings`` the numbers of the rows that have a
    word, by field; both lie in folders by digest, sorted within.  ``rows`` has all that scoring needs of a numbered row.
    What is shuffled are a row's number with each of its words, and a place with each distinct word.
    """
    spark, root = catalogue.sparkSession, path.rstrip("/")
    trusted, complete = _merits()
    whole = [F.col("id"), F.col("position"), F.col("open_date"), trusted.alias("trusted"), complete.alias("complete")]
    number = _row_number(catalogue, whole)
    catalogue.select(number.alias("row"), *whole).distinct().write.option("compression", "zstd").parquet(f"{root}/rows")
    lists = max(1, -(-spark.read.parquet(f"{root}/rows").count() // LIST))
    part = F.pmod(F.xxhash64("row"), F.lit(lists)).cast("int") * BUCKETS + _bucket("word")
    field = F.array_position(F.array(*map(F.lit, _texts())), F.col("field")).cast("tinyint")
    held = _held(catalogue, number.alias("row"), least=LEAST).select("word", field.alias("field"), "row")
    # Folders and parts follow from the other columns, and are told after the shuffle.
    held = held.repartition(part).withColumn("part", part).groupBy("part", "word", "field").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    held = held.select("word", "field", "rows", F.pmod("part", F.lit(BUCKETS)).alias("bucket")).sortWithinPartitions("bucket", "word")
    held.write.partitionBy("bucket").option("compression", "zstd").parquet(f"{root}/postings")
    # Words beside similar ones make small shuffle files.
    words = spark.read.parquet(f"{root}/postings").select("word").distinct().sortWithinPartitions("word")
    words = _runs(words).withColumn("bucket", _bucket(F.col("word").substr(F.col("at"), F.lit(LEAST)))).hint("rebalance", "bucket")
    words = words.select("word", F.col("word").substr(F.col("at"), F.lit(GRAM)).alias("run"), "bucket").sortWithinPartitions("bucket", "run", "word")
    words.write.partitionBy("bucket").option("compression", "zstd").parquet(f"{root}/words")


def _in_buckets(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The folders of a table that some keys fall into; their list is as long as there are folders, at most."""
    found = [r.b for r in keys.select(_bucket(key).alias("b")).distinct().collect()]
    return table.where(F.col("bucket").isin(found))


def _spots(spark: SparkSession, path: str, queries: DataFrame) -> DataFrame:
    """(token, row, field): the numbers of the rows in which the tokens of the queries occur, read from an index.

    Up to ``FEW`` different tokens are looked for in the words of the lists as these are read.
    """
    root = path.rstrip("/")
    asked = _asked(queries)
    few = _few(asked)
    if few is not None:  # a table whose size is known, which Spark sends to all tasks
        known = F.array(*map(F.lit, few)).cast("array<string>")
        asked = spark.range(1).select(F.explode(known).alias("token")).withColumn("fragment", F.substring("token", 1, GRAM))
    held = _in_buckets(spark.read.parquet(f"{root}/words"), asked.select(F.substring("fragment", 1, LEAST).alias("start")), "start")
    begun = F.array_distinct(F.array(*(F.substring("run", 1, n) for n in _lengths(asked))).cast("array<string>"))
    held = held.select("word", F.explode(begun).alias("fragment"))
    fit = held.join(asked, "fragment").filter(F.contains("word", "token")).select("token", "word")
    lists = spark.read.parquet(f"{root}/postings")
    if few is not None:
        found = _in_buckets(lists, fit, "word").select(F.explode(F.filter(known, lambda t: F.contains(F.col("word"), t))).alias("token"), "field", "rows")
    else:
        fit.distinct().write.parquet(kept := scratch(spark, "search-words"))
        fit = spark.read.schema("token string, word string").parquet(kept)
        found = _in_buckets(lists, fit, "word").join(fit, "word")
    names = F.element_at(F.array(*map(F.lit, _texts())), F.col("field").cast("int"))
    return found.select("token", F.explode("rows").alias("row"), "field").distinct().withColumn("field", names)


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/rows")


def postings(spark: SparkSession, path: str, queries: DataFrame) -> DataFrame:
    """(token, id, position, field, open_date, trusted, complete): where the tokens of the queries occur, read from an index."""
    return _spots(spark, path, queries).join(_rows(spark, path), "row").select("token", "id", "position", "field", *KEPT)


def indexed_scores(spark: SparkSession, path: str, queries: DataFrame, as_of: dt.date) -> DataFrame:
    """SR-04 from an index: what :func:`basic_scores` gives, without reading the catalogue."""
    each = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times"))
    counts = _spots(spark, path, queries).join(each, "token").groupBy("query_id", "row").agg(
        *(F.sum(F.when(F.col("field") == n, F.col("times")).otherwise(0)).alias(n) for n in _texts()))
    known = queries.select("query_id", "query", F.size(tokens(F.col("query"))).alias("_k"))
    standing = _standing(*(F.col(c) for c in KEPT), as_of)
    return counts.join(known, "query_id").join(_rows(spark, path), "row").select(
        "query_id", "query", "id", "position", _basic(*(F.col(c) for c in ("_t", "_c", "_d", "_k")), standing).alias("basic_score"))


def basic_scores(catalogue: DataFrame, queries: DataFrame, as_of: dt.date) -> DataFrame:
    """SR-04 for a table of queries: ``(query_id, query, id, position, basic_score)`` of every query and every row it matches.

    Matching is the candidate selection of the search: a token occurs in title, names or description.  A query without
    tokens names no rows here (all would be the same list for each such query; see :func:`standing_list`).
    :func:`basic_score` scores given pairs, matching or not.
    """
    each = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times"))
    hit = matches(catalogue, queries).join(each, "token")
    counts = hit.groupBy("query_id", "id", "position").agg(*(F.sum(F.when(F.col("field") == n, F.col("times")).otherwise(0)).alias(n) for n in _texts()))
    standing = catalogue.select("id", "position", standing_score(as_of).alias("_standing"))
    known = queries.select("query_id", "query", F.size(tokens(F.col("query"))).alias("_k"))
    scored = counts.join(standing, ["id", "position"]).join(known, "query_id")
    return scored.select("query_id", "query", "id", "position", _basic(*(F.col(c) for c in ("_t", "_c", "_d", "_k", "_standing"))).alias("basic_score"))


def _signs(held: dict[str, Column]) -> list[Column]:
    """The bits of the tokens of a group, per field of those that are ``held`` there."""
    found = []
    for f, n in SIGNS.items():
        at = F.pmod(F.xxhash64("token"), F.lit(64 * n)).cast("int")
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), at % 64)
        found += [F.bit_or(F.when(held[f] & (at >= 64 * i) & (at < 64 * i + 64), bit).otherwise(0)).alias(f"{f}{i}") for i in range(n)]
    return found


def _common(f: str, one: str, other: str) -> Column:
    """How many tokens of a query can be in a field of a row, from the signs of both; ``kinds`` is how many it has.

    Tokens that share a bit count as if all were there.
    """
    count = lambda bits: reduce(lambda a, b: a + b, map(F.bit_count, bits))
    asked, there = ([F.col(f"{side}.{f}{i}") for i in range(SIGNS[f])] for side in (one, other))
    both = count([a.bitwiseAND(b) for a, b in zip(asked, there, strict=True)])
    return F.when(both > 0, both + F.col("kinds") - count(asked)).otherwise(0)


def best_scores(catalogue: DataFrame, queries: DataFrame, as_of: dt.date, n: int = STAGE_ONE) -> DataFrame:
    """Those rows of :func:`basic_scores` that can be among a query's ``n`` best: all of these, and others.

    Up to ``FEW`` different tokens this is every row.  Beyond that their number would grow with queries times catalogue,
    and bounds tell most rows apart before they are counted.  The best places of each token alone give every query ``n``
    rows and a score they reach at least, so its best rows reach it too.  A row that cannot reach it by its standing and
    the tokens it may have in common with the query is left out with all its places; the others are counted in full.
    """
    spark, queries = catalogue.sparkSession, queries.where("query_id IS NOT NULL")
    if _few(_asked(queries, LONG)) is not None:
        return basic_scores(catalogue, queries, as_of)

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(path := scratch(spark, name))
        return spark.read.parquet(path)

    # Queries of one id are counted together and scored one by one.
    number = F.monotonically_increasing_id()
    known = kept(queries.select(number.alias("ask"), "query_id", "query", F.size(tokens(F.col("query"))).alias("k")), "search-queries")
    each = known.select("query_id", F.explode(tokens(F.col("query"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times"))
    each = kept(each.join(known.select("query_id", "ask", "k"), "query_id").drop("query_id"), "search-tokens")
    rows = catalogue.groupBy("id", "position", standing_score(as_of).alias("_standing")).agg(F.count("*").alias("copies"))
    rows = kept(rows.select(number.alias("row"), "*"), "search-rows")
    asked = each.select("token", F.substring("token", 1, LONG).alias("fragment")).distinct()
    found = _found(catalogue, asked).groupBy("token", "id", "position").agg(*(F.max((F.col("field") == f).cast("tinyint")).alias(f) for f in _texts()))
    places = kept(found.join(rows.drop("copies"), ["id", "position"]).drop("id"), "search-places")

    def scores(pairs: DataFrame) -> DataFrame:
        counted = pairs.select("ask", "row", "position", "_standing", "k", "reached", *((F.col(f) * F.col("times")).alias(f) for f in _texts()))
        same = [F.max(c).alias(c) for c in ("position", "_standing", "k", "reached")]
        counted = counted.repartition("ask").groupBy("ask", "row").agg(*same, *(F.sum(f).alias(f) for f in _texts()))
        scored = counted.withColumn("basic_score", _basic(*(F.col(c) for c in ("_t", "_c", "_d", "k", "_standing"))))
        w = Window.partitionBy("ask").orderBy(F.desc("basic_score"), "position")
        return scored.where(F.col("basic_score") >= F.col("reached")).withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= n)

    weight = W_TITLE * F.col("_t") + W_CATEGORY * F.col("_c") + W_DESCRIPTION * F.col("_d")
    w = Window.partitionBy("token").orderBy(F.desc(weight + F.col("_standing")), "position")
    alone = places.withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= n).drop("_at")
    reached = scores(each.withColumn("reached", F.lit(-1.0)).join(alone, "token")).where(F.col("_at") == n)
    share = F.coalesce(F.try_divide(F.max("times"), F.max("k")), F.lit(0.0)).alias("share")
    bounds = each.groupBy("ask").agg(share, F.count("*").alias("kinds"), *_signs(dict.fromkeys(SIGNS, F.lit(True))))
    bounds = bounds.join(reached.select("ask", F.col("basic_score").alias("reached")), "ask", "left").na.fill(-1.0, ["reached"])
    bits = places.groupBy("row").agg(*_signs({f: F.col(f) == 1 for f in SIGNS}))
    most = W_TITLE * _common("_t", "q", "r") + W_CATEGORY * _common("_c", "q", "r") + W_DESCRIPTION * _common("_d", "q", "r")
    can = F.col("_standing") + F.col("share") * most >= F.col("reached") - SLACK
    drop = [f"{f}{i}" for f, m in SIGNS.items() for i in range(m)]
    pairs = each.join(bounds, "ask").alias("q").join(places.join(bits, "row").alias("r"), F.col("q.token") == F.col("r.token")).where(can).drop(*drop)
    best = scores(pairs).join(known.select("ask", "query_id", "query"), "ask").join(rows.select("row", "id", "copies"), "row")
    copies = F.explode(F.array_repeat("basic_score", F.col("copies").cast("int"))).alias("basic_score")
    return best.select("query_id", "query", "id", "position", copies)


def standing_list(catalogue: DataFrame, queries: DataFrame, as_of: dt.date, n: int = STAGE_ONE) -> DataFrame:
    """The ``n`` best rows for queries without tokens: those of the highest score no query takes part in, found once for all."""
    none = F.lit(0)
    row = F.struct(F.negate(_basic(none, none, none, none, standing_score(as_of))).alias("s"), F.col("position").alias("position"), F.col("id").alias("id"))
    best = catalogue.select(row.alias("r")).orderBy("r").limit(n).agg(F.sort_array(F.collect_list("r"))).scalar()
    rows = queries.filter(F.size(tokens(F.col("query"))) == 0).select("query_id", "query", F.explode(best).alias("r"))
    return rows.select("query_id", "query", "r.id", "r.position", F.negate(F.col("r.s")).alias("basic_score"))


def top_per_query(scored: DataFrame, n: int, score: str, rank: str = "rank") -> DataFrame:
    """WN-02: the ``n`` best rows of each query; catalogue order decides ties."""
    w = Window.partitionBy("query_id").orderBy(F.desc(score), "position")
    return scored.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def category_match(query: Column, categories: Column) -> Column:
    """SR-06: token hits over all categories per token, at most 1.

    ``categories`` is an array of structs with a ``values`` array of labels.
    """
    toks = tokens(query)
    texts = F.transform(categories, lambda c: F.array_join(c["values"], " "))
    hits = F.aggregate(
        texts, F.lit(0), lambda acc, text: acc + F.size(F.filter(toks, lambda t: F.contains(text, t)))
    )
    # least() passes over NULL, so no tokens and no categories must be 0 before it.
    return F.least(F.coalesce(F.try_divide(hits, F.size(toks)), F.lit(0.0)), F.lit(1.0))


def size_score(total_records: Column) -> Column:
    """SR-07."""
    score = F.when(total_records.isNull(), SIZE_UNKNOWN)
    for least, value in SIZE_STEPS:
        score = score.when(total_records >= least, value)
    return score.otherwise(SIZE_SMALLEST)


def enhanced_score(basic: Column, query: Column, categories: Column, total_records: Column) -> Column:
    """SR-08."""
    score = W_BASIC * basic + W_CLASSES * category_match(query, categories) + W_SIZE * size_score(total_records)
    return F.least(F.round(score, DIGITS), F.lit(1.0))


def enriched(categories: Column) -> Column:
    """SR-10: per category its id, name, number of values and the first of them."""
    return F.transform(categories, lambda c: F.struct(
        c["id"].alias("id"), c["name"].alias("name"), F.size(c["values"]).alias("count"),
        F.slice(c["values"], 1, SAMPLE).alias("sample"),
    ))


def search(
    catalogue: DataFrame, metadata: DataFrame, queries: DataFrame, as_of: dt.date,
    results: int = RESULTS, method: str = "enhanced", index: str | None = None,
) -> DataFrame:
    """SR-09: for each of the queries ``(query_id, query)`` the best rows by basic score, re-ranked with their metadata.

    ``metadata`` is ``(id, total_records, categories)``.  The first stage is written to the scratch
    folder: STAGE_ONE rows per query at most.  The catalogue is thus searched once, and
    titles and metadata are cut to those rows by semi-joins before they are joined.  With an ``index`` (the folder
    :func:`build_index` wrote for this catalogue) the matches are read from its posting lists.
    """
    spark = catalogue.sparkSession
    path = scratch(spark, "search")
    scored = best_scores(catalogue, queries, as_of) if index is None else indexed_scores(spark, index, queries, as_of)
    if not queries.filter(F.size(tokens(F.col("query"))) == 0).isEmpty():
        scored = scored.unionByName(standing_list(catalogue, queries, as_of))
    top_per_query(scored, STAGE_ONE, "basic_score", "basic_rank").write.parquet(path)
    first = spark.read.parquet(path)
    titles = catalogue.select("id", "position", _text("title").alias("title")).join(first.select("id", "position"), ["id", "position"], "left_semi")
    first = first.join(titles, ["id", "position"])
    known = metadata.join(first.select("id"), "id", "left_semi")
    joined = first.join(known, "id", "left")
    if method == "enhanced":
        none = F.array().cast(metadata.schema["categories"].dataType)
        final = enhanced_score(
            F.col("basic_score"), F.col("query"), F.coalesce("categories", none), F.col("total_records")
        )
    else:
        final = F.col("basic_score")
    ranked = joined.withColumn("score", final)
    # Stage-one order decides ties of the final score.
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "basic_rank")
    return ranked.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= results)


def listing(catalogue: DataFrame, n: int = LISTED) -> DataFrame:
    """SR-11: the first tables of the catalogue, unscored."""
    fields = ["id", "title", "gov_org", "survey_date", "open_date", "updated_date"]
    return catalogue.orderBy("position").limit(n).select(*fields)
