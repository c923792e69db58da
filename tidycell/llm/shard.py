"""A reproducible shuffle into shards whose shard and slot are computed, not stored.

Rows get global numbers 0 to n - 1 in an order of their own content, so numbers do
not depend on files, partitions or reruns.  A Feistel network over the smallest
power of two that holds n permutes the numbers; a value of n or more is permuted again
until it falls below n (cycle walking), which keeps it a permutation of 0 to n - 1.
Position p goes to shard p % shards, slot p / shards: the counts of shards
differ by one at most, and slots have no gaps.  The law is ``rows``.

Global numbers take two levels: rows are dealt to ``BUCKETS`` buckets by hash; the
buckets' counts give each its first number, and rows are numbered within their
bucket.  No task sees more than one bucket, and nothing but the counts is gathered.

Defined results: a null text has no bytes and the checksum of the empty text; a
missing id is an id of its own kind; rows that repeat in full get numbers in a row, in any order
among themselves (they are the same); an empty table gives an empty result; extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 8
SEED = 20240229
BUCKETS = 4096
ROUNDS = 4
#: Walks beyond the first; each leaves at most half of the values, so that this many do not end one in 10**38 rows.
WALKS = 128


def features() -> dict[str, Column]:
    """Size and checksum of a row's text."""
    data = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return {"__size": F.octet_length(data).cast("long") + 1, "__crc": F.crc32(data)}


def numbered(rows: DataFrame, counted: DataFrame | None = None) -> tuple[DataFrame, int]:
    """``rows`` (with __size and __crc) and their global numbers as __number; their count.

    counted: the same rows if they can be read at less cost for the counts.
    """
    bucket = F.pmod(F.xxhash64("doc_id", "__crc", "__size"), F.lit(BUCKETS))
    counts = (rows if counted is None else counted).groupBy(bucket.alias("__bucket")).agg(F.count("*").alias("n")).collect()  # BUCKETS rows at most
    first, total = [0] * BUCKETS, 0
    for row in sorted(counts):
        first[row[0]], total = total, total + row.n
    offsets = rows.sparkSession.createDataFrame([(i, n) for i, n in enumerate(first)], "__bucket long, __first long")
    order = Window.partitionBy("__bucket").orderBy("doc_id", "__crc", "__size")
    rows = rows.withColumn("__bucket", bucket).withColumn("__at", F.row_number().over(order))
    return rows.join(offsets, "__bucket").withColumn("__number", F.col("__first") + F.col("__at") - 1).drop("__bucket", "__first", "__at"), total


def permute(x: Column, n: int, seed: int = SEED) -> Column:
    """One pass of the Feistel network over the power of two that holds n."""
    bits = max(2, (n - 1).bit_length())
    high, low = bits // 2, bits - bits // 2
    for k in range(ROUNDS):  # (high | low) becomes (low | high xor f(low)); the halves' lengths swap
        right = x.bitwiseAND(F.lit((1 << low) - 1))
        left = F.shiftright(x, low)
        mixed = left.bitwiseXOR(F.xxhash64(right, F.lit(seed + k)).bitwiseAND(F.lit((1 << high) - 1)))
        x = F.shiftleft(right, high).bitwiseOR(mixed)
        high, low = low, high
    return x


def position(number: Column, n: int, seed: int = SEED) -> Column:
    """The place of a row number in the shuffle of n rows."""
    first = permute(number, n, seed)
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), first, lambda v, _: F.when(v < n, v).otherwise(permute(v, n, seed)))
    walked = F.when(walk < n, walk).otherwise(F.raise_error(F.lit("a cycle is longer than the walk")).cast("long"))
    return F.when(first < n, first).otherwise(walked)


def shuffled(rows: DataFrame, shards: int = SHARDS, seed: int = SEED, counted: DataFrame | None = None) -> DataFrame:
    """``rows`` (with __size and __crc) with __shard and __slot."""
    rows, n = numbered(rows, counted)
    rows = rows.withColumn("__place", position(F.col("__number"), max(n, 1), seed))
    return rows.withColumns({"__shard": F.pmod("__place", F.lit(shards)).cast("int"), "__slot": F.expr(f"__place div {shards}")}).drop("__number", "__place")


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``docs`` with shard and slot; where the table has such a column, in upper or lower case, the first free of shard_2, shard_3 and so on."""
    rows = docs.withColumns(features())
    out = shuffled(rows, shards, seed)
    taken = {c.lower() for c in docs.columns}
    names = [next(x for x in (c, *(f"{c}_{k}" for k in range(2, len(taken) + 3))) if x not in taken) for c in ("shard", "slot")]
    return out.select(*docs.columns, F.col("__shard").alias(names[0]), F.col("__slot").alias(names[1]))
