"""Alignment of two tokenizers against a plain one that looks at all token pairs."""

import hashlib
import json
import pathlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from tidycell.llm import token_alignment as ta
from tidycell.llm.common import stage
from tidycell.llm.entries.op11 import op11_token_alignment

ODD = ["￼�😀 é", "ﬁ ▁ piece", "<|endoftext|> <s> </s>", "\x00\x01 bytes", " " * 3000 + "x", "\n" * 2500, "x" * 3000, "don't  stop\t\n ", "　 \x1c ", "a"]


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(ta.BYTE_VOCABULARY)
    first.encode_special_tokens = True
    return lambda text: first.encode(text, add_special_tokens=False).ids, ta.Pieces(ta.PIECE_VOCABULARY)


def plain(rows, both):
    """The contract's columns by comparing the ranges of all tokens."""
    alphabet = {c: bytes([b]) for c, b in ta._byte_alphabet().items()}
    vocabulary = json.loads(pathlib.Path(ta.BYTE_VOCABULARY).read_text())["model"]["vocab"]
    names = {i: b"".join(map(alphabet.get, p)) for p, i in vocabulary.items() if set(p) <= set(alphabet)}
    docs, counts = [], Counter()
    for doc, text in rows:
        a, b = (both[0](" " + text), both[1].encode(text)) if text else ([], [])
        ends = []
        for ids, piece in ((a, names), (b, dict(enumerate(both[1].bytes)))):
            at, out = 0, []
            for i in ids:
                at += len(piece[i])
                out.append(at)
            ends.append(out)
            if text and b"".join(piece[i] for i in ids) != (" " + text).encode():
                a, b = [], []
        if not a:
            docs.append((doc, [], [], [], []))
            continue
        cut = [(i, j) for i, x in enumerate(ends[0]) for j, y in enumerate(ends[1]) if x == y]
        groups, i, j = [], 0, 0
        for k, m in cut:
            groups.append(",".join(map(str, a[i : k + 1])) + "|" + ",".join(map(str, b[j : m + 1])))
            i, j = k + 1, m + 1
        links = [(a[k], b[m]) for k, m in cut]
        counts.update(links)
        docs.append((doc, a, b, groups, links))
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return sorted((doc, len(a), len(b), len(g), len(l), sum(counts[x] == most[x[1]] for x in l), sum(counts[x] for x in l),
                   hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for doc, a, b, g, l in docs)


def test_alignment_against_all_pairs(spark, both, tmp_path):
    rng = random.Random(2)
    texts = [t for _, t, *_ in cases.ROWS if t is None or len(t) < 5000] + ODD
    texts += ["".join(rng.choice(["ab", " ", "the", "é", "1", ".", "\n", "😀", "  ", "ing"]) for _ in range(rng.randrange(40))) for _ in range(60)]
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = op11_token_alignment(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = plain(rows, both)
    assert sorted(tuple(r) for r in found.collect()) == want
    assert sum(w[1] > 0 for w in want) > 60 and want[texts.index("ﬁ ▁ piece")][1:] == (0, 0, 0, 0, 0, 0, "")


def test_byte_level_ids_are_those_of_the_vocabulary(both, monkeypatch):
    monkeypatch.setattr(ta, "LONG_SPACE", re.compile(f"[{ta.WHITE}]{{3,}}"))  # so that short runs take the long way
    monkeypatch.setattr(ta, "SPARSE", re.compile(""))
    ours, rng = ta.ByteLevel(ta.BYTE_VOCABULARY), random.Random(1)
    for _ in range(2000):
        text = "".join(rng.choice(["a", "Zé", "12", " ", " ", "\n", "\t", "\x85", " ", "　", "\x1c", "'s", "...", "😀"]) for _ in range(rng.randrange(30)))
        assert ours.encode(text) == both[0](text)


@pytest.mark.parametrize("text", [" ", "\n", "x", "."])
def test_very_long_texts_of_one_character(text):
    first, second = ta.ByteLevel(ta.BYTE_VOCABULARY), ta.Pieces(ta.PIECE_VOCABULARY)
    long = text * 1_000_000
    a, b = first.encode(" " + long), second.encode(long)
    assert sum(len(first.bytes[i]) for i in a) == sum(len(second.bytes[i]) for i in b) == 1_000_001
    assert sum(len(x) for x, _ in ta.align(a, b, first.bytes, second.bytes)) == len(a)


def test_pairs_stay_below_the_bound(spark):
    grouped = stage(ta.groups(cases.documents(spark)), "alignment-test")
    first, second = ta.ByteLevel(ta.BYTE_VOCABULARY), ta.Pieces(ta.PIECE_VOCABULARY)
    width = len(second.bytes)
    links = [r.link for r in ta.pair_counts(grouped).collect()]
    for x in links:
        a, b = first.bytes[x // width], second.bytes[x % width]
        assert a.endswith(b) or b.endswith(a)
    assert len(links) == len(set(links)) <= ta.pair_bound() < 400_000


def test_alignment_odd_tables(spark):
    odd = spark.createDataFrame([("x", "some text", 1, "g"), ("x", "some text", 1, "g"), (None, None, 2, None)], "doc_id string, text string, links long, groups string")
    got = [tuple(r)[:4] for r in ta.groups(odd).orderBy("doc_id").collect()]
    assert got == [(None, 0, 0, 0), ("x", 2, 2, 2), ("x", 2, 2, 2)]
    empty = ta.groups(odd.limit(0))
    assert ta.scored(empty, ta.pair_counts(empty)).count() == 0
    assert ta.groups(odd).agg(F.sum("n_a")).first()[0] == 4
