"""Removal of passages that occur earlier, by fingerprints of windows that are dealt by minimizers.

The method it was dealt is suffix trees partitioned by prefix; no tree is built here.  Window
fingerprints (``width`` words, fixed) take its place, dealt by the smallest ``SHORT``-word digest inside a
window; there are no inner nodes and nothing deeper than ``width``.  Below, tree, prefix, leaf and node are
named as the parts of the tree that these stand for.

A suffix of a document is the word sequence from one position on.  Two suffixes
that agree for ``width`` words meet in a node of depth ``width`` or more of the
corpus' suffix tree; its leaves are the places where the repeat occurs.  The
tree is built in parts:

1. Short prefixes.  Every window of ``width`` words has one prefix position (the
   smallest digest of its ``SHORT``-word prefixes, the leftmost of equals), which
   is the same wherever the window occurs.  Prefixes are counted over the corpus.
   A prefix that occurs once is a leaf: its suffixes are not expanded.
2. Long prefixes.  The suffixes below repeated prefixes are expanded to ``width``
   words.  Documents that share their smallest repeated prefix (of those in few
   documents, if any) meet in one task, in groups of bounded size, which builds the part of the tree it can see:
   suffixes sorted by digest, equal neighbours being the leaves of a deep node.
   Only the first leaf of each node goes on.
3. The first leaves of all tasks are partitioned by their whole prefix and sorted;
   a stream over each partition keeps the first leaf of a node and reports
   the others.  It holds one node at a time, so its memory is bounded.

Reported suffixes cover the words to remove; touching ones join to spans, which
are the maximal repeats.  Edges of the tree are kept as digests of word
sequences (96 bits at depth ``width``), not as the words.

Defined results: a null text has no words and keeps none; texts of fewer than
``width`` words have no window; rows that repeat in full are one document and
get the same result; rows that share an id only are ordered by a digest of the
text; a missing id comes last.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidycell.llm.common import id_of, keyed, stage
from tidycell.llm.words import Words, chunks, inside, windows

WIDTH = 20
SHORT = 6
#: Documents that meet in one task by a prefix; a prefix with more is dealt to several groups.
GROUP = 512


def _prefixes(words: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every window: position of its first word, digest and position of its short prefix."""
    short = min(SHORT, width)
    y = windows(words.digests, short)
    p = np.arange(len(y))
    span, size = width - short + 1, 1
    if len(y) < span:
        return (np.zeros(0, np.int64), *(np.zeros(0, t) for t in (np.uint64, np.int64)))

    def least(gap: int) -> None:
        nonlocal y, p
        right = y[gap:] < y[:-gap]
        y, p = np.where(right, y[gap:], y[:-gap]), np.where(right, p[gap:], p[:-gap])

    while size * 2 <= span:
        least(size)
        size *= 2
    if span > size:
        least(span - size)
    ok = np.flatnonzero(inside(words.bounds, width, len(y)))
    return ok, y[ok], p[ok]


def _short_prefixes(width: int):
    schema = pa.schema([("_doc", pa.int64()), ("_key", pa.int64()), ("prefix", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, keys = (batch.column(i).to_numpy() for i in (0, 1))
            texts = batch.column(2).to_pylist()
            for i, j in chunks(texts):
                words = Words(texts[i:j])
                at, y, p = _prefixes(words, width)
                new = np.ones(len(p), bool)
                new[1:] = p[1:] != p[:-1]
                row = i + np.searchsorted(words.bounds, at[new], "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(docs[row]), pa.array(keys[row]), pa.array(y[new].view(np.int64))], schema=schema)

    return run


LEAF = pa.schema([("d1", pa.int64()), ("d2", pa.int32()), ("_doc", pa.int64()), ("_key", pa.int64()), ("at", pa.int32()), ("end", pa.int32())])
LEAF_DDL = "d1 long, d2 int, _doc long, _key long, at int, end int"


def _spans(doc: np.ndarray, key: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Joined spans of windows that touch or overlap."""
    if not len(at):
        return doc, key, at, at
    order = np.lexsort((at, key, doc))
    doc, key, at = doc[order], key[order], at[order]
    new = np.ones(len(at), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (at[1:] > at[:-1] + width)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return doc[first], key[first], at[first], at[last] + width


def _local_trees(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, keys = (batch.column(i).to_numpy() for i in (0, 1))
            texts = batch.column(2).to_pylist()
            lists = batch.column(3)
            ends = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
            parts = [tuple(np.zeros(0, t) for t in (np.int64, np.int32, np.int64, np.int64, np.int32))]
            for i, j in chunks(texts):
                words = Words(texts[i:j])
                at, y, _ = _prefixes(words, width)
                at = at[np.isin(y, values[ends[i]:ends[j]])]
                row = np.searchsorted(words.bounds, at, "right") - 1
                d1, d2 = (windows(words.digests, width, s)[at].view(np.int64) for s in (1, 2))
                parts.append((d1, d2.astype(np.int32), docs[i + row], keys[i + row], (at - words.bounds[row]).astype(np.int32)))
            d1, d2, doc, key, at = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((at, key, doc, d2, d1))
            d1, d2, doc, key, at = (x[order] for x in (d1, d2, doc, key, at))
            first = _first(d1, d2)
            same = (doc == doc[first]) & (key == key[first]) & (at == at[first])  # of a repeated row
            lead = first == np.arange(len(first))
            yield pa.RecordBatch.from_arrays([pa.array(x[lead]) for x in (d1, d2, doc, key, at)] + [pa.array(np.zeros(lead.sum(), np.int32))], schema=LEAF)
            more = ~same
            doc, key, at, end = _spans(doc[more], key[more], at[more], width)
            spread = (np.arange(len(at), dtype=np.int64) * 2654435761) ^ doc  # deals the spans out evenly
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (spread, spread.astype(np.int32), doc, key, at.astype(np.int32), end.astype(np.int32))], schema=LEAF)

    return run


def _first(d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    """Index of the first row of each row's node, rows being sorted by digest."""
    new = np.ones(len(d1), bool)
    new[1:] = (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])
    return np.maximum.accumulate(np.where(new, np.arange(len(d1)), 0)) if len(d1) else np.zeros(0, np.int64)


def _later_leaves(width: int):
    schema = pa.schema([("_doc", pa.int64()), ("_key", pa.int64()), ("span", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = None  # digests and place of the open node's first leaf
        for batch in batches:
            d1, d2, doc, key, at, end = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            done = end > 0  # spans that are known already pass through
            out = [(doc[done], key[done], at[done], end[done])]
            d1, d2, doc, key, at = (x[~done] for x in (d1, d2, doc, key, at))
            if len(d1):
                first = _first(d1, d2)
                fd, fk, fa = doc[first], key[first], at[first]
                if lead is not None and (d1[0], d2[0]) == lead[:2]:
                    open_ = first == 0
                    fd, fk, fa = np.where(open_, lead[2], fd), np.where(open_, lead[3], fk), np.where(open_, lead[4], fa)
                later = (doc != fd) | (key != fk) | (at != fa)
                lead = (d1[-1], d2[-1], fd[-1], fk[-1], fa[-1])
                out.append(_spans(doc[later], key[later], at[later], width))
            doc, key, at, end = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(key), pa.array((at.astype(np.int64) << 32) | end.astype(np.int64))], schema=schema)

    return run


def repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(_doc, _key, span): words to remove, as start << 32 | end (word positions, end exclusive)."""
    rows = keyed(docs)
    found = rows.mapInArrow(_short_prefixes(width), "_doc long, _key long, prefix long")
    counts = stage(found.groupBy("prefix").agg(F.count("*").alias("n")).where("n > 1"), "prefixes")
    per_doc = found.join(counts, "prefix").groupBy("_doc", "_key").agg(F.collect_set("prefix").alias("prefixes"), F.min(F.struct(F.expr(f"n > {GROUP}"), "prefix", "n")).alias("least"))
    expand = rows.join(per_doc, ["_doc", "_key"]).select(
        "_doc", "_key", "text", "prefixes", F.col("least.prefix").alias("meet"),
        F.pmod(F.xxhash64("_doc", "_key"), F.ceil(F.col("least.n") / F.lit(GROUP)).cast("long")).alias("part"))
    leaves = expand.repartition("meet", "part").mapInArrow(_local_trees(width), LEAF_DDL)
    leaves = leaves.repartition("d1").sortWithinPartitions("d1", "d2", "_doc", "_key", "at")
    return leaves.mapInArrow(_later_leaves(width), "_doc long, _key long, span long")


def _strip():
    schema = pa.schema([("_doc", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            n_words, n_removed, kept = [], [], []
            for text, cut in zip(texts, spans):
                words = (text or "").encode("utf-8", "replace").split()
                n_words.append(len(words))
                if cut:
                    gone = np.zeros(len(words) + 1, np.int64)
                    code = np.array(cut, np.int64)
                    np.add.at(gone, code >> 32, 1)
                    np.add.at(gone, code & 0xFFFFFFFF, -1)
                    stay = np.flatnonzero(np.cumsum(gone)[:-1] == 0)
                    n_removed.append(len(words) - len(stay))
                    words = [words[i] for i in stay.tolist()]
                else:
                    n_removed.append(0)
                kept.append(b" ".join(words).decode("utf-8"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], schema=schema)

    return run


def dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): every document without the words of repeats, joined by one space."""
    spans = repeats(docs, width).groupBy("_doc", "_key").agg(F.collect_list("span").alias("spans"))
    rows = keyed(docs).join(spans, ["_doc", "_key"], "left").select("_doc", "text", "spans")
    return rows.mapInArrow(_strip(), "_doc long, n_words long, n_removed long, kept string").select(id_of("_doc").alias("doc_id"), "n_words", "n_removed", "kept")
