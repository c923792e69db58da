"""Benchmark passages in documents, by Wu-Manber multi-pattern search over words.

Words are runs of ``a-z``, ``0-9`` and characters beyond U+007F, after A-Z are
lower-cased.  A pattern is a window of 13 consecutive words of a benchmark item;
an item of fewer, but not none, is one pattern.  For patterns of m words the
search looks at the last two words of the place where a pattern could end.  The
shift table says how far the place can move on without passing an occurrence
(m - 1 words if no pattern holds these two); at shift 0 a bucket, chosen by
these two words and the pattern's first one, names the patterns to compare
with the document's words directly.

Documents are searched where they are read; nothing is shuffled.  The benchmark
is dealt to blocks of some ``BLOCK_WORDS`` words, which tasks write to the shared folder and Spark hands to every executor as
files; the driver sees their names only.  A task searches ``CHUNK`` bytes of documents for one block after the
other, so it holds one block's tables whatever the benchmark's size, and builds them once per chunk (once, if there is one block).  An
item longer than a block is in one block.

Defined results: a null text has no words; an item without id or without words
is no item; rows with one item_id are one item; rows of documents are judged one by one,
repeated or not; an empty benchmark leaves all documents clean.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidycell.session import scratch

WINDOW = 13
BLOCK_WORDS = 200_000
CHUNK = 64_000_000
#: Bytes as they count in words; the others are spaces.
_KEEP = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_KEEP).split()


class Patterns:
    """Shift tables and buckets for some items, by pattern length."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        found: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            words = split(text)
            m = min(window, len(words))
            for i in range(len(words) - m + 1 if m else 0):
                found.setdefault(tuple(words[i : i + m]), set()).add(item)
        self.single = {p[0]: ids for p, ids in found.items() if len(p) == 1}
        self.tables: dict[int, tuple[dict, dict]] = {}
        for p, ids in found.items():
            m = len(p)
            if m == 1:
                continue
            shift, bucket = self.tables.setdefault(m, ({}, {}))
            for end in range(2, m + 1):
                block = p[end - 2 : end]
                if m - end < shift.get(block, m - 1):
                    shift[block] = m - end
            bucket.setdefault((p[0], *p[-2:]), []).append((list(p), ids))

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Occurrences as (start, end), and the items they belong to."""
        spans, items = [], set()
        if self.single:
            for i, w in enumerate(words):
                if w in self.single:
                    spans.append((i, i + 1))
                    items |= self.single[w]
        n = len(words)
        for m, (shift, bucket) in self.tables.items():
            far, look, i = m - 1, shift.get, m - 1
            while i < n:
                step = look((words[i - 1], words[i]), far)
                if step:
                    i += step
                    continue
                start = i - m + 1
                for pattern, ids in bucket.get((words[start], words[i - 1], words[i]), ()):
                    if words[start : i + 1] == pattern:
                        spans.append((start, i + 1))
                        items |= ids
                i += 1
        return spans, items


def covered(spans: list[tuple[int, int]]) -> int:
    """Words in at least one span."""
    total, done = 0, 0
    for a, b in sorted(spans):
        if b > done:
            total += b - max(a, done)
            done = b
    return total


def _chunks(batches: Iterator[pa.RecordBatch], text_at: int, chunk: int) -> Iterator[list[pa.RecordBatch]]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(text_at).nbytes
        if size >= chunk:
            yield held
            held, size = [], 0
    if held:
        yield held


def _scan(names: list[str], window: int, text_at: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, at, patterns = list(names), None, None
        for held in _chunks(batches, text_at, chunk):
            texts = [batch.column(text_at).to_pylist() for batch in held]
            spans, items = [[[] for _ in part] for part in texts], [[set() for _ in part] for part in texts]
            for name in order:
                if name != at:
                    table = pq.read_table(SparkFiles.get(name))
                    at, patterns = name, Patterns(list(zip(*(c.to_pylist() for c in table.columns))), window)
                for part, found, known in zip(texts, spans, items):
                    for k, text in enumerate(part):
                        s, i = patterns.search(split(text))
                        if s:
                            found[k] += s
                            known[k] |= i
            order.reverse()  # the next chunk begins with the tables at hand
            for batch, part, found, known in zip(held, texts, spans, items):
                out = [pa.array([len(split(t)) for t in part], pa.int64()), pa.array([covered(s) for s in found], pa.int64()), pa.array([sorted(i) for i in known], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*batch.schema.names, "__n_words", "__n_hit", "__items"])

    return run


def blocks_of(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> list[str]:
    """The names under which tasks find the benchmark's items, dealt to files of bounded size."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    words = items.agg(F.sum(F.length("text"))).first()[0] or 0  # characters bound the words
    path = scratch(spark, "benchmark")
    items.repartition(-(-words // (3 * block_words)) or 1).write.parquet(path)
    files = spark.read.schema(items.schema).parquet(path).inputFiles()
    for file in files:
        spark.sparkContext.addFile(file)
    return sorted(os.path.basename(file) for file in files)


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, chunk: int = CHUNK) -> DataFrame:
    """``docs`` with __n_words, __n_hit and __items (ids of the items that occur, as strings)."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(_scan(blocks_of(benchmark, block_words), window, docs.columns.index("text"), chunk), f"{fields}, __n_words long, __n_hit long, __items array<string>")


def contaminated() -> Column:
    return (F.col("__n_hit") > 0) & (20 * F.col("__n_hit") >= F.col("__n_words"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their columns."""
    return scan(docs, benchmark).where(~contaminated()).select(*docs.columns)
