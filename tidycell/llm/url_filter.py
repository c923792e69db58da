"""Verdicts on URLs by host and path rules, looked up in a sorted digest array.

A rule is ``host/path``: it fits the host and all its subdomains, if the URL's path
starts with ``/path``.  Rules carry a verdict; the longest rule that fits decides.
Where none fits, the block list decides: entries of the same form that block.  All
else is allowed.

The entries' 64-bit xxhash digests are dealt by range to blocks of some ``BLOCK`` entries, which tasks sort and write to the
shared folder.  Spark hands the blocks' files to every executor, also to one that starts later; there each becomes a sorted
array with the entries' text beside it, which tasks memory-map.  So the list may have any length: the driver
sees names of files, and an executor needs disk for the list, not memory.  For a URL the keys
are the suffixes of its host that are no longer than some entry's, joined to those path prefixes that are as long as
some entry's path, so their size does not grow with the host; digests of a whole batch of keys are found by one binary
search of each array, and a hit counts only if the stored text equals the key.

Defined results: a null URL, or one without ``://``, has empty host and path and is
allowed; rows are judged one by one, repeated or not; entries without text or ``/`` are refused;
equal entries count once, a rule before a list entry, block before allow.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidycell.session import scratch

BLOCK = 1_000_000
#: That of Spark's xxhash64.
HASH_SEED = 42
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
BLOCKED = ("cheap-pills.example.com/", "spam-farm.example.org/")


def host(url: str = "url") -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def entries(spark: SparkSession, rules: Sequence[tuple[str, str]] = RULES, blocked: Sequence[str] = BLOCKED) -> DataFrame:
    """(entry, verdict, listed) from rules and list entries given in the program."""
    rows = [(e, v, False) for e, v in rules] + [(e, "block", True) for e in blocked]
    return spark.createDataFrame(rows, "entry string, verdict string, listed boolean")


def _once(table: DataFrame) -> DataFrame:
    """Each entry once, a rule before a list entry and block before allow."""
    known = table.select("entry", "verdict", "listed").withColumn("entry", F.when(F.instr("entry", "/") > 0, F.col("entry")).otherwise(F.raise_error(F.lit("an entry needs the form host/path"))))
    return known.groupBy("entry").agg(F.min(F.struct("listed", (F.col("verdict") != "block").alias("soft"))).alias("e")).select(
        "entry", F.col("e.listed").alias("listed"), F.when(F.col("e.soft"), "allow").otherwise("block").alias("verdict"))


def digests(keys: Sequence[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(k, HASH_SEED) for k in keys), np.uint64, len(keys)).view(np.int64)


def write_blocks(known: DataFrame, blocks: int) -> list[str]:
    """The names under which tasks find the files of the index: entries by digest, a range of digests to a file."""
    spark = known.sparkSession
    path = scratch(spark, "url-index")
    flag = (2 * F.col("listed").cast("int") + (F.col("verdict") == "block").cast("int")).cast("byte")
    rows = known.select(F.xxhash64("entry").alias("digest"), "entry", flag.alias("flag"))
    rows.repartitionByRange(blocks, "digest").sortWithinPartitions("digest").write.parquet(path)
    files = spark.read.schema(rows.schema).parquet(path).inputFiles()
    for file in files:
        spark.sparkContext.addFile(file)
    return sorted(os.path.basename(file) for file in files)


def write_index(rows: pa.Table, name: str) -> None:
    """One file of (digest, entry, flag) rows in order of their digests: count, digests, offsets, flags, text."""
    texts = [e.encode() for e in rows["entry"].to_pylist()]
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    columns = [rows["digest"].to_numpy().astype(np.int64), offsets, rows["flag"].to_numpy().astype(np.uint8)]
    draft = f"{name}.{uuid.uuid4().hex}"
    with open(draft, "wb") as f:
        f.write(np.int64(len(texts)).tobytes() + b"".join(c.tobytes() for c in columns) + b"".join(texts))
    os.replace(draft, name)  # other tasks of the executor may do the same


def mapped(name: str) -> Index:
    """The index of a file that Spark handed to this executor; made beside it once, in Spark's own folder."""
    file = SparkFiles.get(name)
    if not os.path.exists(f"{file}.index"):
        write_index(pq.read_table(file), f"{file}.index")
    return Index(f"{file}.index")


class Index:
    """The memory-mapped file of ``write_index``."""

    def __init__(self, name: str):
        data = np.memmap(name, np.uint8, "r")
        n = int(data[:8].view(np.int64)[0])
        at = 8 + 8 * n
        self.digests = data[8:at].view(np.int64)
        self.offsets = data[at : at + 8 * (n + 1)].view(np.int64)
        at += 8 * (n + 1)
        self.flags, self.text = data[at : at + n], data[at + n :]

    def find(self, keys: list[bytes], want: np.ndarray) -> dict[int, int]:
        """Position of the entry of every key that has one, by the key's; ``want`` are the keys' digests."""
        n, out = len(self.digests), {}
        if not n:
            return out
        at = np.searchsorted(self.digests, want)
        for k in np.flatnonzero((at < n) & (self.digests[np.minimum(at, n - 1)] == want)).tolist():
            i = int(at[k])
            while i < n and self.digests[i] == want[k]:  # all entries of one digest
                if self.entry(i) == keys[k]:
                    out[k] = i
                    break
                i += 1
        return out

    def entry(self, i: int) -> bytes:
        return self.text[self.offsets[i] : self.offsets[i + 1]].tobytes()


def keys_of(host: str, path: str, lengths: Sequence[int], most: int) -> list[bytes]:
    """All texts an entry that fits can have: suffixes of the host, no longer than some entry's host (``most``), with prefixes of the path."""
    low = max(0, len(host) - most)
    starts = [0] * (not low) + [i + 1 for i in range(max(0, low - 1), len(host)) if host[i] == "."]
    ends = [path[:n] for n in lengths if len(path) >= n]
    return [(host[s:] + e).encode("utf-8", "replace") for s in starts for e in ends]


def _probe(names: Sequence[str], lengths: Sequence[int], most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [mapped(n) for n in names]
        for batch in batches:
            hosts, paths = (batch.column(batch.schema.names.index(c)).to_pylist() for c in ("__host", "__path"))
            keys, ends = [], []
            for h, p in zip(hosts, paths):
                keys += keys_of(h, p, lengths, most)
                ends.append(len(keys))
            want, flags = digests(keys), {}
            for block in blocks:
                flags.update((k, int(block.flags[i])) for k, i in block.find(keys, want).items())
            rules, verdicts = [], []
            start = 0
            for end in ends:
                hits = [k for k in range(start, end) if k in flags]
                start = end
                own = [k for k in hits if not flags[k] & 2]
                if own:
                    # The keys of a URL come by falling length of their hosts: of equally long rules the first holds.
                    best = max(own, key=lambda k: len(keys[k].decode()))
                    rules.append(keys[best].decode())
                    verdicts.append("block" if flags[best] & 1 else "allow")
                else:
                    rules.append(None)
                    verdicts.append("block" if any(flags[k] & 1 for k in hits) else "allow")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], names=[*batch.schema.names, "__rule", "__verdict"])

    return run


def judge(pages: DataFrame, known: DataFrame, block: int = BLOCK) -> DataFrame:
    """``pages`` with __host, __path, __rule and __verdict."""
    known = _once(known)
    # One row per length of the entries' paths.
    sizes = known.select(F.expr("length(entry) - instr(entry, '/') + 1").alias("path"), F.expr("instr(entry, '/') - 1").alias("host")).groupBy("path").agg(
        F.max("host").alias("host"), F.count("*").alias("n")).collect()
    lengths, most = sorted(r.path for r in sizes), max((r.host for r in sizes), default=0)
    names = write_blocks(known, -(-sum(r.n for r in sizes) // block) or 1)
    pages = pages.withColumns({"__host": host(), "__path": path()})
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)
    return pages.mapInArrow(_probe(names, lengths, most), f"{fields}, __rule string, __verdict string")
