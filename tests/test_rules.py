"""Rule tables, whole hierarchies and typed documents against plain Python."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.conftest import values
from tidycell.operators import domains, labels, rules
from tidycell.sources import tables

CODES = "category_id string, code string, parent_code string"


def test_rule_table_against_the_case_chain(spark, rows):
    titles = rows("id int, title string", *((i, t) for i, t in enumerate(["国勢調査 人口", "GDP 統計", "労働と教育", "", None, "気象", "林業の企業", "人口", "人口"])))
    table = rules.rule_table(spark, domains.DOMAIN_TERMS)
    found = rules.categorised(titles, table, "title", "domain", "generic")
    assert found.columns == ["id", "title", "domain"]
    assert values(found, "id", "domain") == values(titles.select("id", domains.infer_domain(F.col("title")).alias("domain")))


def test_ten_thousand_rules(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcdé業") for _ in range(n))
    table = [(word(rng.randrange(1, 3)) if k % 500 == 0 else word(rng.randrange(4, 9)), f"c{k % 50}", rng.randrange(10_000)) for k in range(10_000)] + [("", "blank", 0)]
    texts = [(i, word(rng.randrange(0, 40))) for i in range(150)]
    found = rules.categorised(spark.createDataFrame(texts, "i int, t string"), spark.createDataFrame(table, "term string, category string, priority int"), "t", "c", "none")
    want = [(i, min(((p, c) for term, c, p in table if term and term in t), default=(0, "none"))[1]) for i, t in texts]
    assert values(found, "i", "c") == sorted(want, key=repr)
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    none = rules.categorised(spark.createDataFrame(texts, "i int, t string"), spark.createDataFrame([], "term string, category string, priority int"), "t", "c", "none")
    assert none.where("c <> 'none'").isEmpty()


def test_hierarchy_against_walking_up(spark):
    rng = random.Random(3)
    parent = {f"n{i}": "" if i == 0 else f"n{rng.randrange(max(0, i - 4), i)}" for i in range(120)}
    parent |= {"x1": "x2", "x2": "x3", "x3": "x1", "below": "x2", "self": "self", "orphan": "nowhere"}
    codes = spark.createDataFrame([("k", c, p) for c, p in parent.items()] + [("other", "n1", "")], CODES)

    def up(code):
        way = [code]
        while (p := parent[way[-1]]) in parent:
            if p in way:
                return None
            way.append(p)
        return way[::-1]

    got = {r.code: (r.depth, r.path, r.circular) for r in labels.hierarchy(codes).where("category_id = 'k'").collect()}
    for code in parent:
        way = up(code)
        assert got[code] == ((None, None, True) if way is None else (len(way) - 1, " > ".join(way), False))
    amounts = [("k", f"n{rng.randrange(120)}", rng.choice([0.1, 0.2, 1e15, None])) for _ in range(300)]
    n, total = defaultdict(int), defaultdict(list)
    for _, code, v in amounts:
        for above in up(code):
            n[above] += v is not None
            total[above].append(v or 0)
    for r in labels.rolled_up(codes, spark.createDataFrame(amounts, "category_id string, code string, value double")).where("category_id = 'k'").collect():
        assert r.n == n[r.code] and (r.total or 0) == pytest.approx(sum(total[r.code]))
    assert labels.hierarchy(codes.limit(0)).count() == 0


def test_typed_documents(spark, rows, tmp_path):
    path = str(tmp_path / "docs")
    docs = rows("dataset_id string, metadata_json string", ("1", '{"a": {"n": 5, "t": "x"}}'), ("2", '{"a": {"n": "five"}}'), ("3", '{"a": '), ("4", None), ("5", "[1, 2]"))
    assert values(tables.save_documents(docs, path), "dataset_id") == [("3",), ("4",)]
    found = tables.load_documents(spark, path, {"n": ("$.a.n", "bigint"), "t": ("$.a.t", "string")})
    assert values(found) == [("1", 5, "x"), ("2", None, None), ("5", None, None)]
    assert dict(tables.load_documents(spark, path).dtypes)["document"] == "variant"
