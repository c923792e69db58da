"""Periodic runs against a search over all periods."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tests.llm import cases
from tidycell.llm import periodic_runs
from tidycell.llm.entries.op12 import op12_periodic_runs, repeated
from tidycell.llm.words import Words


def every_run(w, least=24, times=3):
    out = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b, q) for (a, b), q in out.items())


def made(rng):
    w = []
    for _ in range(rng.randrange(1, 7)):
        kind = rng.random()
        if kind < 0.3:
            w += [f"n{rng.randrange(10**6)}" for _ in range(rng.randrange(60))]
        elif kind < 0.6:
            root = [rng.choice("ab") for _ in range(rng.randrange(1, 40))]
            w += (root * rng.randrange(2, 20))[: rng.randrange(1, 300)]
        elif kind < 0.8:
            w += [rng.choice("ab") for _ in range(rng.randrange(100))]
        else:
            w += ["a"] * rng.randrange(120)
    return w


@pytest.mark.parametrize("seed", range(4))
def test_every_run_is_found(seed):
    rng = random.Random(seed)
    for _ in range(15):
        texts = [made(rng) for _ in range(8)]
        for w, got in zip(texts, periodic_runs._of_texts(Words([" ".join(t) for t in texts]))):
            assert sorted(map(tuple, got.tolist())) == every_run(w)


def test_runs_of_a_fibonacci_word_and_of_one_word():
    a, b = "a", "ab"
    while len(b) < 700:
        a, b = b, b + a
    assert sorted(map(tuple, periodic_runs._of_texts(Words([" ".join(b)]))[0].tolist())) == every_run(b)
    assert periodic_runs._of_texts(Words(["same " * 200_000]))[0].tolist() == [[0, 200_000, 1]]
    with pytest.raises(ValueError):
        periodic_runs.runs(np.zeros(9, np.uint64), 3, times=2)


def planted(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def contract(doc_id, text):
    w = planted(doc_id, text)
    found = every_run(w)
    best = max(found, key=lambda r: (Fraction(r[1] - r[0], r[2]), -r[0], -r[2]), default=None)
    gone = {i for a, b, q in found for i in range(a + q, b)}
    digest = lambda b: hashlib.sha256(b).hexdigest()
    lines = "".join(f"{a},{b - a},{q}\n" for a, q, b in sorted((a, q, b) for a, b, q in found))
    row = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *row, digest(lines.encode()), digest(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_against_its_contract(spark, tmp_path):
    rng = random.Random(9)
    rows = [(r[0], r[1]) for r in cases.ROWS if len(r[1] or "") < 5000] + [(100 + i, " ".join(made(rng)) if i % 7 else " ".join(f"u{k}" for k in range(i * 3))) for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted((tuple(r) for r in op12_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    assert found == sorted((contract(*r) for r in rows), key=repr)
    hit = [i for i, t in rows if i is not None and t and zlib.crc32(str(i).encode()) % 10 == 0]
    assert len(hit) > 5 and sum(r[1] > 0 for r in found) > 60


def test_repeated_stretch_of_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r.text for r in repeated(docs).collect()}
    for r in docs.collect():
        assert cases.words(got[r.doc_id]) == planted(r.doc_id, r.text)


def test_runs_odd_tables(spark):
    docs = cases.documents(spark).withColumnRenamed("lang", "runs").withColumnRenamed("source", "Collapsed")
    by = {(r.doc_id, r.n_words): (len(r.runs), r.strongest, r.collapsed) for r in periodic_runs.detect(docs).collect()}
    assert by[8, 50][0] == 1 and by[8, 50][1].asDict() == {"start": 0, "length": 50, "period": 1} and by[8, 50][2] == "word"
    assert by[4, 0] == by[5, 0] == by[6, 0] == (0, None, "") and (None, 14) in by
    assert periodic_runs.detect(docs.limit(0)).count() == 0
    text = docs.limit(1).selectExpr("'id' as doc_id", "text")
    assert periodic_runs.detect(text).first().doc_id == "id"
