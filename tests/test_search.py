import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import values
from tidycell.operators import search as R

AS_OF = dt.date(2024, 6, 30)
FIELDS = ("id", "title", "statistics_name", "main_category", "sub_category", "description", "gov_org", "open_date", "title_spec")
TABLES = [
    ("1", "人口 推計 年次", "国勢調査", "人口", "世帯", "年次の人口", "総務省", "2024-01-01", "spec"),
    ("2", "労働 調査", "労働力調査", "労働", "", "", "厚生労働省統計", "2021-06-30", ""),
    ("3", "年次 報告", "", "", "", "人口", "民間", "", "x"),
    ("4", "調査 人口 労働", "s", "m", "c", "d", "内閣府", "2016/01/01", "t"),
    ("5", "古い 人口", "", "", "", "", "", "2010-01-01", ""),
    ("6", "無関係", "s", "m", "c", "d", "総務省", "2024-06-01", "t"),
    ("7", "人口 推計 年次", "国勢調査", "人口", "世帯", "年次の人口", "総務省", "2024-01-01", "spec"),
]
QUERIES = ["人口 推計", "労働 a 調査", "人口", "x", "年次   報告", "none of these"]


@pytest.fixture(scope="module")
def catalogue(spark):
    return spark.createDataFrame([(i, *t) for i, t in enumerate(TABLES)], "position int, " + ", ".join(f"{f} string" for f in FIELDS))


def fresh(text):
    try:
        d = (AS_OF - dt.datetime.strptime(text, "%Y-%m-%d").date()).days
    except ValueError:
        return None
    if d <= 365:
        return 1.0
    if d <= 1825:
        return 1.0 - (d - 365) / 1460 * 0.5
    return 0.5 - (d - 1825) / 1825 * 0.5 if d <= 3650 else 0.0


def brute(query, t):
    row = dict(zip(FIELDS, t))
    toks = [w for w in query.split() if len(w) > 1]
    names = f"{row['statistics_name']} {row['main_category']} {row['sub_category']}"
    hits = [sum(k in text for k in toks) for text in (row["title"], names, row["description"])]
    score = sum(w * h / len(toks) for w, h in zip((0.25, 0.15, 0.10), hits)) if toks else 0.0
    if row["open_date"]:
        f = fresh(row["open_date"])
        score += 0.075 if f is None else 0.15 * f
    score += 0.1 * any(o in row["gov_org"] for o in ("総務省", "警察庁", "国土交通省", "厚生労働省", "内閣府"))
    score += 0.05 * sum(bool(row[c]) for c in ("statistics_name", "description", "title_spec")) / 3
    return (not toks or sum(hits) > 0), score


def table_of(catalogue, queries):
    return catalogue.sparkSession.createDataFrame(list(enumerate(queries)), "query_id int, query string")


def test_basic_scores_against_brute_force(catalogue):
    got = {(r.query, r.id): r.basic_score for r in R.basic_scores(catalogue, table_of(catalogue, QUERIES), AS_OF).collect()}
    want = {(q, t[0]): s for q in QUERIES if q != "x" for t in TABLES for matched, s in [brute(q, t)] if matched}
    assert set(got) == set(want)
    for key, score in want.items():
        assert got[key] == pytest.approx(score, abs=1e-8), key


def test_ties_keep_catalogue_order(catalogue):
    top = R.top_per_query(R.basic_scores(catalogue, table_of(catalogue, ["人口 推計"]), AS_OF), 2, "basic_score").orderBy("rank").collect()
    assert [r.id for r in top] == ["1", "7"]


def test_tokens_and_replacement(rows):
    df = rows("q string", ("  a bb　ccc\td ",), ("",))
    assert [r[0] for r in df.select(R.tokens(F.col("q"))).collect()] == [["bb", "ccc"], []]
    assert [r[0] for r in df.select(R.apply_replacements(F.col("q"), {"bb": "B", "x": "y"})).collect()] == ["a B ccc d", ""]
    assert df.select(R.apply_replacements(F.col("q"), {})).first()[0] == "a bb ccc d"


def test_suggestions(rows):
    dictionary = rows("term string, suggested string, reason string, alternatives array<string>", ("収入", "所得", "r", ["x"]), ("給料", "賃金", "r", []))
    queries = rows("query_id int, query string", (1, "収入 給料"), (2, "収入 所得"), (3, "収入額"), (4, "給料 給料"))
    assert values(R.suggestions(queries, dictionary), "query_id", "term", "suggested") == [(1, "収入", "所得"), (1, "給料", "賃金"), (4, "給料", "賃金")]


def test_sizes(rows):
    df = rows("n bigint", (None,), (10000,), (9999,), (999,), (99,), (9,))
    assert [r[0] for r in df.select(R.size_score(F.col("n"))).collect()] == [0.5, 1.0, 0.9, 0.7, 0.5, 0.3]


def test_category_match(rows):
    df = rows("c array<struct<id: string, name: string, values: array<string>>>", ([("a", "A", ["東京 都", "大阪"]), ("b", "B", ["東京"])],), ([],), (None,))
    q = lambda text: [r[0] for r in df.select(R.category_match(F.lit(text), F.col("c"))).collect()]
    assert q("東京 京都 名古屋") == [pytest.approx(2 / 3), 0.0, 0.0]
    assert q("東京") == [1.0, 0.0, 0.0]
    assert q("x") == [0.0, 0.0, 0.0]


def test_search_reranks_with_metadata(spark, catalogue):
    metadata = spark.createDataFrame(
        [("5", 20000, [("cat01", "C", ["人口"])]), ("1", 5, []), ("4", None, [])], "id string, total_records bigint, categories array<struct<id: string, name: string, values: array<string>>>")
    got = R.search(catalogue, metadata, table_of(catalogue, ["人口"]), AS_OF, results=10).orderBy("rank").collect()
    basic = {t[0]: s for t in TABLES for m, s in [brute("人口", t)] if m}
    size = {"5": 1.0, "1": 0.3}
    want = {i: 0.8 * s + (0.15 if i == "5" else 0) + 0.05 * size.get(i, 0.5) for i, s in basic.items()}
    assert {r.id: pytest.approx(r.score, abs=1e-8) for r in got} == want
    assert [r.score for r in got] == sorted((r.score for r in got), reverse=True)
    plain = R.search(catalogue, metadata, table_of(catalogue, ["人口"]), AS_OF, results=1, method="basic").first()
    assert (plain.id, plain.rank) == ("1", 1)


def test_enriched(rows):
    df = rows("c array<struct<id: string, name: string, values: array<string>>>", ([("a", "A", list("abcdefg"))],))
    assert df.select(R.enriched(F.col("c"))).first()[0] == [("a", "A", 7, list("abcde"))]


def test_given_pairs_keep_rows_that_do_not_match(catalogue):
    for query in QUERIES:
        got = {r.id: r.s for r in catalogue.select("id", R.basic_score(F.lit(query), AS_OF).alias("s")).collect()}
        assert got == {t[0]: pytest.approx(brute(query, t)[1], abs=1e-8) for t in TABLES}


def test_queries_without_tokens_share_one_list(catalogue):
    got = R.standing_list(catalogue, table_of(catalogue, ["x", "人口", ""]), AS_OF, 3).collect()
    best = sorted(((-round(brute("x", t)[1], 9), i, t[0]) for i, t in enumerate(TABLES)))[:3]
    assert sorted((r.query_id, r.id) for r in got) == sorted((q, i) for q in (0, 2) for _, _, i in best)


def test_long_tokens_and_characters_beyond_the_basic_plane(spark):
    rows = spark.createDataFrame([(0, "a", "x𠮷野家牛丼 abcdefgh", "", "", "", "", "", "", "")], "position int, id string, " + ", ".join(f"{f} string" for f in FIELDS[1:]))
    queries = spark.createDataFrame([(1, "𠮷野家牛"), (2, "bcdefgh zz"), (3, "abcdx"), (4, "bcde bcde")], "query_id int, query string")
    got = {r.query_id: r.basic_score for r in R.basic_scores(rows, queries, AS_OF).collect()}
    assert got == {1: 0.25, 2: 0.125, 4: 0.25}


def test_accepted_words_per_query(rows):
    queries = rows("query_id int, query string", (1, "a b a"), (2, "a b"), (3, " "))
    accepted = rows("query_id int, term string, suggested string", (1, "a", "z"), (1, "a", "y"), (2, "b", "c"), (2, "q", "r"))
    assert values(R.apply_accepted(queries, accepted), "query_id", "query") == [(1, "y b y"), (2, "a c"), (3, "")]


def test_index_gives_what_the_scan_gives(spark, catalogue, tmp_path, monkeypatch):
    asked = spark.createDataFrame(list(enumerate([*QUERIES, "推計 a 推計", "査", "世帯 調査 労働"])), "query_id int, query string")
    path = str(tmp_path / "index")
    R.build_index(catalogue, path)
    scanned = values(R.basic_scores(catalogue, asked, AS_OF))
    assert values(R.indexed_scores(spark, path, asked, AS_OF)) == scanned and len(scanned) > 10
    monkeypatch.setattr(R, "FEW", 0)  # the words of the catalogue, as for many tokens
    assert values(R.basic_scores(catalogue, asked, AS_OF)) == scanned
    assert R.indexed_scores(spark, path, asked.limit(0), AS_OF).count() == 0
    none = asked.where("query_id = 5")
    assert R.indexed_scores(spark, path, none, AS_OF).count() == R.basic_scores(catalogue, none, AS_OF).count() == 0


def test_a_search_reads_only_its_tokens_postings(spark, catalogue, tmp_path):
    path = str(tmp_path / "index")
    R.build_index(catalogue, path)
    asked = spark.createDataFrame([(1, "世帯")], "query_id int, query string")
    found = R.postings(spark, path, asked)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert any("bucket" in x.split("]")[0] for x in plan.split("PartitionFilters: [")[1:])
    folders = spark.read.parquet(f"{path}/postings").select("bucket").distinct().count()
    assert folders > 10 and values(found, "token", "id", "field") == values(R.matches(catalogue, asked), "token", "id", "field") != []


def test_an_index_has_one_row_for_a_place_in_a_word(spark, catalogue, tmp_path):
    path = str(tmp_path / "index")
    R.build_index(catalogue, path)
    words = spark.read.parquet(f"{path}/words")
    distinct = [r.word for r in words.select("word").distinct().collect()]
    assert words.count() == sum(len({w[i:i + R.GRAM] for i in range(len(w) - 1)}) for w in distinct)
    # Tokens of every length find every word that has them, at its beginning, within and at its end.
    word = max(distinct, key=len)
    tokens = sorted({word[i:i + n] for n in range(2, len(word) + 1) for i in range(len(word) - n + 1)})
    asked = spark.createDataFrame(list(enumerate(tokens)), "query_id int, query string")
    assert values(R.postings(spark, path, asked), "token", "id", "field") == values(R.matches(catalogue, asked), "token", "id", "field")


def test_tokens_of_one_beginning_meet_few_words(spark, monkeypatch):
    """Words with a common fragment do not meet all tokens that begin with it."""
    words = spark.createDataFrame([(f"pre{i:02d}tionabcd{i:02d}xy",) for i in range(40)], "word string")
    queries = spark.createDataFrame([(i, f"tionabcd{i:02d}x") for i in range(40)] + [(98, "tion"), (99, "onabcd07xy")], "query_id int, query string")
    seen, lengths = [], R._lengths
    monkeypatch.setattr(R, "_lengths", lambda asked: seen.append(asked) or lengths(asked))
    rows = words.select(F.monotonically_increasing_id().alias("position"), F.col("word").alias("id"), F.col("word").alias("title"), *(F.lit("").alias(f) for f in FIELDS if f not in ("id", "title", "position")))
    monkeypatch.setattr(R, "FEW", 0)
    found = values(R.matches(rows, queries), "token", "id")
    assert found == sorted(((r.query, w.word) for r in queries.collect() for w in words.collect() if r.query in w.word), key=repr)
    met = R._fragments(words, lengths(seen[0])).join(seen[0], "fragment").count()
    assert len(found) <= met <= 2 * len(found)


@pytest.fixture(scope="module")
def large(spark):
    """Rows that share words, some of them twice, and queries of one to six words, some of them under one number."""
    draw = random.Random(5)
    known = [f"{a}{b}" for a in ("stat", "popu", "work", "xx") for b in ("istics", "lation", "force", "istical", "ab")]
    text = lambda n: " ".join(draw.choice(known) for _ in range(draw.randint(0, n)))
    dates = ["", "2015/01", "2024-01-01", "2021-06-30", "2010-01-01", "2018-02-03"]
    rows = [(i, str(i), f"common {text(3)}", text(1), "", "", text(9), draw.choice(["総務省", "x"]), draw.choice(dates), draw.choice(["", "s"])) for i in range(400)]
    rows += rows[:9] + [(i, str(i), "common stat", "", "", "", "xx", "", "2024-06-01", "") for i in range(9)] + [(None, "n", *rows[0][2:]), (500, None, *rows[0][2:]), (None, "0", *rows[1][2:])]
    asked = [(i, " ".join(draw.choice([*known, "common", "stat", "lati", "none"]) for _ in range(draw.randint(1, 6)))) for i in range(60)]
    asked += [(3, "common xx"), (3, ""), (4, asked[4][1]), (None, "common"), (70, "x"), (71, "common common stat")]
    return spark.createDataFrame(rows, "position int, " + ", ".join(f"{f} string" for f in FIELDS)), spark.createDataFrame(asked, "query_id int, query string")


def test_bounds_leave_the_best_rows(large, monkeypatch):
    catalogue, asked = large
    lists = lambda scored, n: values(R.top_per_query(scored, n, "basic_score"), "query_id", "position", "basic_score", "rank")
    want = {n: lists(R.basic_scores(catalogue, asked, AS_OF), n) for n in (1, 5, 1000)}
    monkeypatch.setattr(R, "FEW", 0)
    for signs in (R.SIGNS, {"_t": 1, "_c": 1, "_d": 1}):
        monkeypatch.setattr(R, "SIGNS", signs)
        for n in want if signs is R.SIGNS else (5,):
            assert lists(R.best_scores(catalogue, asked, AS_OF, n), n) == want[n], n


def test_a_search_counts_few_rows_of_common_words(spark, monkeypatch):
    """The rows a search ranks do not grow with queries times catalogue."""
    days = [f"{y}-{m:02d}-15" for y in range(2015, 2024) for m in range(1, 13)]
    rows = spark.createDataFrame(
        [(i, str(i), f"common word{i % 50}", "s", "m", "c", "d", "", days[i % len(days)], "t") for i in range(1500)], "position int, " + ", ".join(f"{f} string" for f in FIELDS))
    asked = spark.createDataFrame([(i, f"common word{i}") for i in range(50)], "query_id int, query string")
    metadata = spark.createDataFrame([], "id string, total_records bigint, categories array<struct<id: string, name: string, values: array<string>>>")
    found = lambda: values(R.search(rows, metadata, asked, AS_OF, results=10, method="basic"), "query_id", "id", "score", "rank")
    want, ranked, top = found(), [], R.top_per_query
    monkeypatch.setattr(R, "FEW", 0)
    monkeypatch.setattr(R, "top_per_query", lambda scored, *a: ranked.append(scored) or top(scored, *a))
    assert found() == want and len(want) == 500
    assert R.basic_scores(rows, asked, AS_OF).count() == 50 * 1500
    assert ranked[0].count() <= 50 * R.STAGE_ONE


def test_an_index_has_one_list_for_a_word(spark, large, tmp_path, monkeypatch):
    """Rows are named by numbers, and their other columns are not repeated with each of their words."""
    catalogue = large[0].where("position >= 20")
    asked = large[1].where("query_id BETWEEN 10 AND 59")
    want = values(R.basic_scores(catalogue.where("id IS NOT NULL"), asked, AS_OF))
    seen = catalogue.count()
    for most in (seen, 50):
        monkeypatch.setattr(R, "LIST", most)
        R.build_index(catalogue, path := str(tmp_path / f"index{most}"))
        lists, held = spark.read.parquet(f"{path}/postings"), R._held(catalogue, least=R.LEAST)
        kept = lists.selectExpr("word", "field", "size(rows) AS n").groupBy("word", "field").agg(F.count("*").alias("lists"), F.sum("n").alias("n"))
        assert sorted(r.n for r in kept.collect()) == sorted(r["count"] for r in held.groupBy("word", "field").count().collect())
        assert kept.agg(F.max("lists")).first()[0] == (1 if most == seen else -(-seen // 50))
        assert {"id", "position", *R.KEPT}.isdisjoint(lists.columns)
        for few in (R.FEW, 0):
            monkeypatch.setattr(R, "FEW", few)
            got = R.indexed_scores(spark, path, asked, AS_OF)
            assert values(got.where("id IS NOT NULL")) == want and got.where("id IS NULL").count() > 0


def test_an_index_tells_rows_apart_that_share_a_position(spark, tmp_path):
    same = [(7, "a", "one two", "2024-01-01"), (7, "b", "two", "2024-01-01"), (7, "b", "three", "2010-01-01"), (None, "a", "one", ""), (None, None, "two one", ""), (8, "", "one", None), (8, None, "one", "")]
    rows = spark.createDataFrame([(p, i, t, "", "", "", "", "", d, "") for p, i, t, d in same], "position int, " + ", ".join(f"{f} string" for f in FIELDS))
    R.build_index(rows, path := str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, "one"), (2, "two three")], "query_id int, query string")
    got = sorted(((r.query, r.position, r.id, round(r.basic_score, 8)) for r in R.indexed_scores(spark, path, asked, AS_OF).collect()), key=repr)
    want = [(q, p, i, round(s, 8)) for q in ("one", "two three") for p, i, t, d in same for m, s in [brute(q, ("", t, *[""] * 5, d or "", ""))] if m]
    assert got == sorted(want, key=repr) and len(got) == 9
