"""The automaton against edit distances, and the score on documents it was not trained on."""

import random
import zlib

import numpy as np
import pytest

from tests.llm import cases
from tidycell.llm import toxicity as tx


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("seed,remembered", [(1, 200_000), (2, 5)])
def test_automaton_finds_the_nearest_term(monkeypatch, seed, remembered):
    monkeypatch.setattr(tx, "REMEMBERED", remembered)
    rng = random.Random(seed)
    word = lambda low, high: "".join(rng.choice("abc") for _ in range(rng.randrange(low, high)))
    terms = sorted({word(1, 13) for _ in range(40)})
    machine = tx.Automaton(terms)
    for _ in range(1500):
        w = word(0, 15)
        near = [(d, k) for k, t in enumerate(terms) for d in [distance(w, t)] if d <= tx.allowed(len(t))]
        assert machine.match(w) == (min(near) if near else None)


CLEAN = "the quick review of a long day in town with plain words and nothing else to report about it".split()


def corpus(seed, n=400):
    """Documents and labels: toxic ones call someone names, some clean ones quote the names."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(CLEAN) + rng.choice(["", "s", str(rng.randrange(30))]) for _ in range(rng.randrange(15, 60))]
        toxic = i % 5 == 0
        for _ in range(3 if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["gribblenorf", "snorklewump", "plundercack"]))
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_score_of_documents_it_was_not_trained_on(spark):
    docs, labels = corpus(4)
    extra = [(1000, "you are a gribblenorff and a snorclewump"), (1001, "he said the word \"gribblenorf\" was quoted in the review of the day and nothing else about it"),
             (1002, None), (1003, ""), (1004, "x" * 500_000 + " gribblenorf"), (None, "plain words")]
    docs = spark.createDataFrame(docs + extra, "doc_id long, text string")
    labels = spark.createDataFrame(labels + [(1, 1, 1), (5, None, None), (1002, 1, 5)], "doc_id long, quality int, toxic int")  # 1 is labelled both ways
    model = tx.train(docs, labels)
    assert {"gribblenorf", "plundercack", "snorklewump"} <= set(model.terms) and len(model.terms) <= 5
    got = {r.doc_id: r.score for r in tx.score(docs, model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all((got[i] >= 0.5) == (i % 5 == 0) for i in held)
    assert got[1000] >= 0.5 > got[1002] == got[1003] == got[None]  # misspelled terms
    assert got[1001] < tx.train(docs, labels).score("he is the gribblenorf was in the review of the day and nothing else about it at all")
    again = tx.train(docs.repartition(7), labels.repartition(5))
    assert again.weights == model.weights and again.bias == model.bias


def test_held_out_rows_are_never_trained_on(spark):
    docs, labels = corpus(5)
    other = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    a, b = (tx.train(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, other))
    assert (a.terms, a.weights, a.bias) == (b.terms, b.weights, b.bias)


def test_context_tells_quotation_from_abuse():
    def used(text):
        words = list(tx.WORD.finditer(text))
        return tx.abuse(text, words, next(k for k, w in enumerate(words) if w.group() == "bad"))

    assert used("you are bad") > used("this is bad") > used("she said this is bad") > used("she wrote \"this is bad\" to him")
    assert used("«bad» it was") < 0.5 < used("«good» and bad «fine»")


def test_toxicity_on_the_given_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = tx.train(docs, labels)
    rows = tx.score(docs, model).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").where(tx.held_out()).collect()
    hits = [r.score >= 0.5 for r in rows if r.toxic == 1 and r.lang == "en"]
    assert np.mean(hits) == 1 and not any(r.score >= 0.5 for r in rows if r.toxic == 0)


def test_toxicity_odd_tables(spark):
    docs = cases.documents(spark).withColumnRenamed("lang", "score").withColumnRenamed("source", "Toxic")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = tx.train(docs, none)
    got = [r.score for r in tx.score(docs, model).collect()]
    assert len(got) == len(cases.ROWS) and got == pytest.approx([0.25] * len(got))
    assert tx.score(docs.limit(0), model).count() == 0
    assert tx.train(docs.limit(0), none).terms == []
    text = docs.select(docs["doc_id"].cast("string").alias("doc_id"), "text")
    assert tx.score(text, model).count() == len(cases.ROWS)
