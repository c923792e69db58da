"""Documents whose sets of word n-grams have a Jaccard similarity of ``threshold`` or more.

Banded MinHash, then exact verification.  The method it was dealt is an LSH forest; fixed bands
take its place: no trie is built, and no prefix is shortened by what the data hold.

1. Every document becomes the set of digests of its ``n``-word shingles (a text
   of fewer words, but not none, is one shingle).  Documents with one set form a
   class; a class is compared once, however many copies it has.
2. There are ``trees`` bands.  A class' path in a band is a sequence of min-hashes,
   as many in all bands: the most, up to ``DEEPEST``, at which pairs at the
   threshold meet in some band with probability ``recall`` (see ``depth``; 7 for
   0.8 and 0.999).  Two classes are candidates if their whole paths in a band agree.
   A lone pair at exactly 0.8 is missed with probability (1 - 0.8**7)**32 = 0.0005.
3. Classes that meet, directly or over others, form a neighbourhood.  Each
   neighbourhood is verified as a whole: its shingle sets travel once, and
   intersections of all its pairs are counted exactly, in blocks.  A large
   neighbourhood is cut by set size (similar sets have similar sizes) and
   then into blocks of bounded bytes, and every pair of blocks is a task of its
   own, so no group is gathered and no pair is written.  Pairs that the
   bands missed are found here too if other classes led to one neighbourhood.
4. Links lead to connected components, found by star contraction.

Defined results: null texts and texts without words have no shingles, link to nothing and are their
own class and group; rows that repeat in full are copies; rows that share an id
only are told apart by a digest of the text; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidycell.llm.common import components, doc_key, id_of, keyed, stage
from tidycell.llm.words import Words, chunks, inside, mix, windows

N = 5
THRESHOLD = 0.8
RECALL = 0.999
TREES = 32
DEEPEST = 8
#: Shingles and classes in a block; two blocks and their table of pairs fit a task.
BLOCK_SHINGLES = 750_000
BLOCK_CLASSES = 1500


def depth(threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, deepest: int = DEEPEST) -> int:
    """The longest prefix at which pairs at the threshold meet in some trie with the target probability."""
    d = deepest
    while d > 1 and 1 - (1 - threshold**d) ** trees < recall:
        d -= 1
    return d


def shingles(words: Words, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle digests of every text."""
    all_ = windows(words.digests, n)
    out = []
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(all_[a : b - n + 1]))
        else:
            out.append(windows(words.digests[a:b], b - a, seed=b - a) if b > a else all_[:0])
    return out


def _signatures(n: int, trees: int, levels: int):
    schema = pa.schema([("_doc", pa.int64()), ("_key", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("n_set", pa.int64()), ("paths", pa.list_(pa.int64()))])
    factors = mix(np.arange(1, trees * levels + 1, dtype=np.uint64)) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for i, j in chunks(texts, 1_000_000):
                sets = shingles(Words(texts[i:j]), n)
                sizes = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(sizes)
                c1, c2 = np.zeros((2, len(sets)), np.uint64)
                paths = np.zeros((len(sets), trees), np.uint64)
                if len(full):
                    flat = np.concatenate(sets)
                    at = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                    c1[full] = mix(np.add.reduceat(mix(flat), at) + sizes[full].astype(np.uint64))
                    c2[full] = mix(np.add.reduceat(mix(flat ^ np.uint64(0x5851F42D4C957F2D)), at))
                    for t in range(trees):
                        path = np.full(len(full), t + 1, np.uint64)
                        for f in factors[t * levels : (t + 1) * levels]:
                            path = mix(path * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(flat * f, at))
                        paths[full, t] = path
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, paths.size + 1, trees, dtype=np.int32)), pa.array(paths.ravel().view(np.int64)))
                rows = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)), pa.array(sizes), lists], schema=schema)

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for i, j in chunks(texts):
                sets = pa.array([s.tobytes() for s in shingles(Words(texts[i:j]), n)], pa.binary())
                rows = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*rows.columns[1:], sets], names=[*rows.schema.names[1:], "shingles"])

    return run


def shared(values: np.ndarray, member: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets, given as (value, member) entries, without a set repeating a
    value: a table of the members in ``left`` by those in ``right``.

    Values in many sets are counted by products of 0/1 matrices, a thousand values at a time; each of
    the others by the few pairs of sets that have it.
    """
    m = int(max(left.max(), right.max())) + 1
    row, col = np.full(m, -1), np.full(m, -1)
    row[left], col[right] = np.arange(len(left)), np.arange(len(right))
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(values, kind="stable")
    values, member = values[order], member[order]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(values)))
    often = count >= 24
    which = np.repeat(np.cumsum(often) - 1, count)
    dense = np.repeat(often, count)
    for start in range(0, int(often.sum()), 1024):
        here = dense & (which >= start) & (which < start + 1024)
        table = np.zeros((m, min(1024, int(often.sum()) - start)), np.float32)
        table[member[here], which[here] - start] = 1
        out += table[left] @ table[right].T
    value, member = np.repeat(np.arange(len(count)), count)[~dense], member[~dense]
    flat = out.ravel()
    for gap in range(1, 24):
        same = np.flatnonzero(value[gap:] == value[:-gap])
        if not len(same):
            break
        for a, b in ((member[same], member[same + gap]), (member[same + gap], member[same])):
            ok = (row[a] >= 0) & (col[b] >= 0)
            np.add.at(flat, row[a[ok]] * len(right) + col[b[ok]], 1)
    return out


FOUND = "cid long, n_links long, root long"


def _verify(threshold: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Of the classes in one or two blocks: links to classes of the (other) block, and a root that
        linked classes share."""
        rows = rows.sort_values(["side", "cid"]).drop_duplicates(["side", "cid"])  # a repeated row comes twice
        sets = [np.frombuffer(s, np.uint64) for s in rows["shingles"]]
        size = np.array([len(s) for s in sets])
        cid, copies, side = (rows[c].to_numpy() for c in ("cid", "copies", "side"))
        empty = pd.DataFrame({"cid": [], "n_links": [], "root": []}, dtype="int64")
        one = rows["one_block"].iloc[0]
        left = np.flatnonzero(side == 0)
        right = left if one else np.flatnonzero(side == 1)
        if not len(left) or not len(right) or len(sets) < 2:
            return empty
        common = shared(np.concatenate(sets), np.repeat(np.arange(len(sets)), size), left, right)
        linked = common * (1 + threshold) >= threshold * (size[left][:, None] + size[right][None, :]) - 1e-6
        if one:
            np.fill_diagonal(linked, False)
        links = np.zeros(len(sets), np.int64)
        links[left] += linked @ copies[right]
        if not one:
            links[right] += linked.T @ copies[left]
        root = np.arange(len(sets))
        while True:  # the smallest index that is reachable
            before = root.copy()
            for a, b, t in ((left, right, linked), (right, left, linked.T)):
                root[a] = np.minimum(root[a], np.where(t, root[b][None, :], len(sets)).min(1))
            root = np.minimum(root, root[root])
            if (root == before).all():
                break
        has = links > 0
        return pd.DataFrame({"cid": cid[has], "n_links": links[has], "root": cid[root[has]]})

    return run


def near_duplicates(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(_doc, _key, _root, doc_id, copy_id, class_id, n_links) for every row of ``docs``.

    copy_id: smallest id of the documents with the same shingle set.  class_id: smallest id of the
    documents reachable over links.  n_links: documents at the threshold or above, copies included.
    _root: what the rows of a class share; NULL without words.
    """
    levels = depth(threshold, recall)
    rows = keyed(docs)
    sig = stage(rows.mapInArrow(_signatures(n, TREES, levels), "_doc long, _key long, c1 long, c2 long, n_set long, paths array<long>"), "signatures")
    # Classes: one row per distinct shingle set, known by a digest of the set.
    classes = stage(sig.where("n_set > 0").groupBy("c1", "c2").agg(F.min(F.struct("_doc", "_key", "n_set", "paths")).alias("rep"), F.count("*").alias("copies"))
                    .select(F.col("c1").alias("cid"), "c2", "copies", "rep.*"), "classes")
    # Candidates: classes that share a path of the same trie.
    paths = classes.select("cid", F.explode("paths").alias("path"))
    meet = paths.groupBy("path").agg(F.min("cid").alias("least"), F.count("*").alias("n")).where("n > 1").select("path", "least")
    star = paths.join(meet, "path").where("cid != least").select(F.col("cid").alias("a"), F.col("least").alias("b"))
    near = components(star, "candidates")
    # Verification, in tasks of one or two blocks.
    member = classes.drop("paths", "c2").join(near.withColumnRenamed("node", "cid"), "cid")
    ratio = math.log(1 / threshold) * (1 + 1e-9)
    whole = member.groupBy("root").agg(F.sum("n_set").alias("all_set"), F.count("*").alias("all_n"))
    small = (F.col("all_set") <= BLOCK_SHINGLES) & (F.col("all_n") <= BLOCK_CLASSES)
    member = member.join(whole, "root").withColumn("band", F.when(small, F.lit(-1)).otherwise(F.floor(F.log("n_set") / F.lit(ratio)).cast("int")))
    bands = member.groupBy("root", "band").agg(F.ceil(F.greatest(F.sum("n_set") / BLOCK_SHINGLES, F.count("*") / BLOCK_CLASSES)).cast("int").alias("blocks"))
    sides = bands.alias("x").join(bands.alias("y"), (F.col("x.root") == F.col("y.root")) & (F.col("y.band") == F.col("x.band") + 1) & (F.col("x.band") >= 0), "left") \
        .select("x.root", "x.band", "x.blocks", F.coalesce("y.blocks", F.lit(0)).alias("above"))
    below = sides.select("root", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below")).where("band > 0")
    plan = sides.join(below, ["root", "band"], "left").na.fill(0, ["below"])
    member = member.drop("all_set", "all_n").join(plan, ["root", "band"]).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    texts = rows.join(member, ["_doc", "_key"]).select("text", "cid", "root", "copies", "band", "block", "blocks", "above", "below")
    sets = texts.mapInArrow(_sets(n), "cid long, root long, copies long, band int, block int, blocks int, above int, below int, shingles binary")
    # The tasks of a class: its block with itself and each other one of the band, with those of the next band and those of the band before.
    tasks = F.expr("""flatten(array(
        transform(sequence(0, blocks - 1), j -> named_struct('band1', band, 'block1', least(block, j), 'band2', band, 'block2', greatest(block, j), 'side', if(j >= block, 0, 1))),
        if(above > 0, transform(sequence(0, above - 1), j -> named_struct('band1', band, 'block1', block, 'band2', band + 1, 'block2', j, 'side', 0)), array()),
        if(below > 0, transform(sequence(0, below - 1), j -> named_struct('band1', band - 1, 'block1', j, 'band2', band, 'block2', block, 'side', 1)), array())))""")
    dealt = sets.select("cid", "root", "copies", "shingles", F.explode(tasks).alias("t")).select(
        "cid", F.col("root").alias("hood"), "copies", "shingles", "t.*", F.expr("t.band1 = t.band2 and t.block1 = t.block2").alias("one_block"))
    found = stage(dealt.groupBy("hood", "band1", "block1", "band2", "block2").applyInPandas(_verify(threshold), FOUND), "links")
    links = found.groupBy("cid").agg(F.sum("n_links").alias("linked"))
    group = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")), "groups").withColumnRenamed("node", "cid")
    known = classes.select("cid", "c2", "copies", F.col("_doc").alias("_copy")).join(links, "cid", "left").join(group, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = known.groupBy("root").agg(F.min("_copy").alias("_least"))
    known = known.join(least, "root").select(F.col("cid").alias("c1"), "c2", F.col("root").alias("_root"), "copies", "linked", "_copy", "_least")
    full = F.col("n_set") > 0
    return sig.select("_doc", "_key", F.when(full, F.col("c1")).alias("c1"), F.when(full, F.col("c2")).alias("c2")).join(known, ["c1", "c2"], "left").select(
        "_doc", "_key", "_root", id_of("_doc").alias("doc_id"), id_of(F.coalesce("_copy", "_doc")).alias("copy_id"), id_of(F.coalesce("_least", "_doc")).alias("class_id"),
        F.coalesce(F.col("copies") - 1 + F.coalesce("linked", F.lit(0)), F.lit(0)).cast("long").alias("n_links"))


def survivors(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``docs`` with one row of each class: the one with the smallest id (then text digest).  Documents
    without words stay."""
    found = stage(near_duplicates(docs, n, threshold, recall), "survivors")
    kept = found.where("_root is not null").groupBy("_root").agg(F.min(F.struct("_doc", "_key")).alias("k"), F.count("*").alias("n"))
    stay = kept.select("k.*").union(found.where("_root is null").select("_doc", "_key"))
    rows = docs.withColumns({"__doc": doc_key(), "__key": F.xxhash64(F.col("text").cast("string"))})
    once = found.groupBy("_doc", "_key").agg(F.count("*").alias("times")).join(stay.distinct(), ["_doc", "_key"])
    once = once.select(F.col("_doc").alias("__doc"), F.col("_key").alias("__key"), (F.col("times") > 1).alias("__again"))
    rows = rows.join(once, ["__doc", "__key"])
    # A row that repeats in full is a copy of itself, which only then needs its text compared.
    single, again = rows.where("not __again"), rows.where("__again").dropDuplicates(["__doc", "__key"])
    return single.union(again).select(*docs.columns)
