"""Operators on texts against brute force."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from tidycell.llm import jaccard_join, substring_dedup, token_counts


def near(rows, n=5, threshold=0.8):
    """Links and groups of distinct rows by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = cases.words(text)
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    links, root = defaultdict(int), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [links[i] for i in range(len(rows))], [find(i) for i in range(len(rows))]


def mutated(seed, n=120):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefghij") + str(rng.randrange(400)) for _ in range(rng.randrange(3, 120))] for _ in range(12)]
    out = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(50)}"
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize("block", [1500, 3])
def test_jaccard_join_finds_every_link(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK_CLASSES", block)
    rows = mutated(block)
    found = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    links, groups = near(rows)
    assert sorted((r.doc_id, r.n_links, r.class_id) for r in found) == [(i, links[i], groups[i]) for i in range(len(rows))]


def test_jaccard_join_odd_rows(spark):
    docs = cases.documents(spark)
    found = {(r.doc_id, r.n_links, r.class_id) for r in jaccard_join.near_duplicates(docs).collect()}
    # The two copies of 2 and the near copy 3 link to each other; 10 is a copy of 11; nulls and empty texts to none.
    assert {(2, 2, 2), (3, 2, 2), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (None, 0, None), (10, 1, 10), (11, 1, 10)} <= found
    kept = jaccard_join.survivors(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]
    assert jaccard_join.survivors(docs.limit(0)).count() == 0


def test_prefix_is_shortened_to_the_recall():
    assert jaccard_join.depth(0.8, 0.999) < jaccard_join.depth(0.8, 0.9) <= jaccard_join.DEEPEST
    d = jaccard_join.depth(0.8, 0.999)
    assert 1 - (1 - 0.8**d) ** jaccard_join.TREES >= 0.999


def deduplicated(rows, width):
    """Kept words of every distinct row, windows being seen in order of id and text."""
    seen, out = {}, {}
    for key in rows:
        w = cases.words(key[1])
        gone = set()
        for i in range(len(w) - width + 1):
            if tuple(w[i : i + width]) in seen:
                gone.update(range(i, i + width))
            else:
                seen[tuple(w[i : i + width])] = True
        out[key] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
    return out


@pytest.mark.parametrize("seed,width", [(1, 20), (2, 7)])
def test_substring_dedup(spark, seed, width):
    rng = random.Random(seed)
    passages = [[f"{rng.choice('xyz')}{rng.randrange(30)}" for _ in range(rng.randrange(5, 60))] for _ in range(6)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(rng.randrange(0, 5)):
            w += rng.choice(passages) if rng.random() < 0.6 else [f"n{rng.randrange(10**6)}" for _ in range(10)]
        rows.append((i, " ".join(w) if w else None))
    rows += [(100, "a " * 90), (101, "a b " * 45), (102, "a " * 30)]
    want = deduplicated(rows, width)
    found = substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), width).collect()
    assert sorted(tuple(r) for r in found) == sorted((k[0], *v) for k, v in want.items())


def test_substring_dedup_odd_rows(spark):
    found = substring_dedup.dedup(cases.documents(spark)).collect()
    assert len(found) == len(cases.ROWS)
    by = defaultdict(list)
    for r in found:
        by[r.doc_id].append((r.n_words, r.n_removed))
    assert by[1] == [(72, 0)] and by[2] == [(67, 60), (67, 60)] and by[4] == [(0, 0)] and by[5] == [(0, 0)]
    assert by[8] == [(50, 49)]  # the second window, and so all but the first word, is seen earlier
    assert by[None] == [(14, 0)]
    assert substring_dedup.dedup(cases.documents(spark).limit(0)).count() == 0


def test_token_counts_equal_full_encoding(spark):
    encode = token_counts.encoding().encode_ordinary
    rng = random.Random(5)
    texts = [t or "" for _, t, *_ in cases.ROWS] + ["  two  spaces\n\n\nlines \t x" * 60, "x" * 3000, " " * 3000, "don't " * 400]
    for text in texts:
        assert token_counts.Tree(text, encode).total == len(encode(text))
        for _ in range(20):
            places = sorted(rng.randrange(len(text) + 1) for _ in range(2 * rng.randrange(1, 5)))
            edits = [(a, b, rng.choice(["", " ", "new", " word", "\n", "'s"])) for a, b in zip(places[0::2], places[1::2])]
            edits = [e for k, e in enumerate(edits) if not k or e[0] > edits[k - 1][1]]
            tree = token_counts.Tree(text, encode)
            new, again = tree.apply(edits)
            want, at = "", 0
            for a, b, put in edits:
                want, at = want + text[at:a] + put, b
            want += text[at:]
            assert new == want and tree.total == len(encode(want))


@pytest.mark.parametrize("seed", range(3))
def test_a_tree_takes_one_edit_after_another(monkeypatch, seed):
    monkeypatch.setattr(token_counts, "cuts", lambda text, size=20, real=token_counts.cuts: real(text, size))
    monkeypatch.setattr(token_counts, "LEAF_CHARS", 20)
    encode, rng = token_counts.encoder(), random.Random(seed)
    tree = token_counts.Tree("some words to begin with, " * 30, encode)
    text, fewer = tree.text, 0
    for _ in range(150):
        places = sorted(rng.randrange(len(text) + 1) for _ in range(2 * rng.randrange(1, 4)))
        edits = [(a, min(b, a + rng.choice([0, 3, 200])), rng.choice(["", " ", "new", " long words " * 9, "\n", "'s", "x" * 60])) for a, b in zip(places[0::2], places[1::2])]
        edits = [e for k, e in enumerate(edits) if not k or e[0] > edits[k - 1][1]]
        want, at = "", 0
        for a, b, put in edits:
            want, at = want + text[at:a] + put, b
        want += text[at:]
        new, again = tree.apply(edits)
        assert new == tree.text == want and tree.total == len(encode(want)) and tree.ends[-1] == len(want)
        fewer += again < len(want) / 2
        text = want
    assert fewer > 20
    tree.apply([(0, len(text), "")])
    assert tree.total == 0
    tree.apply([(0, 0, "back again")])
    assert tree.total == len(encode("back again"))


@pytest.mark.parametrize("piece", [" ", "\n", "x", "ab ", " \t\u3000", "1"])
def test_token_counts_of_very_long_texts(piece):
    encode = token_counts.encoder()
    tree = token_counts.Tree(piece * (2_000_000 // len(piece)) + " end", encode)
    assert tree.total == len(encode(tree.text))
    tree.apply([(0, 0, "start "), (1_000_000, 1_000_003, "middle")])
    assert tree.total == len(encode(tree.text))


def test_token_counts_of_edited_documents(spark):
    encode = token_counts.encoding().encode_ordinary
    lines = "first line\nmail me@host.org now\nfirst line\n\n\nfirst line"
    docs = cases.documents(spark).union(spark.createDataFrame([(20, lines, "en", "a", 1)], cases.DDL))
    found = token_counts.count(docs).where("doc_id in (4, 7, 20)").collect()
    by = {r.doc_id: (r["__tokens"], r["__edits"], r["__tokens_after"]) for r in found}
    assert by[4] == (0, 0, 0) and by[7][0] == len(encode(cases.LONG))
    assert by[20] == (len(encode(lines)), 3, len(encode("first line\nmail <email> now\n\n")))
    assert token_counts.count(docs.limit(0)).count() == 0


def test_documents_keep_their_columns(spark):
    docs = cases.documents(spark)
    assert token_counts.count(docs).columns[: len(docs.columns)] == docs.columns
    assert docs.agg(F.count("*")).first()[0] == len(cases.ROWS)
