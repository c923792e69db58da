"""Documents mixed to target weights by Sainte-Lague apportionment of equal-token blocks.

Sources, ordered by code point with the missing one last, weigh 5, 2, 1, repeating.  They
share all words by weight; a source's target stops at ``MOST`` times its size
and the excess is shared by the others, until none is above.  With the sources
in order of size / weight the level at which the last one stops follows from running sums.

The words are cut into equal blocks, ``FINE`` to the smallest target and of one word at least, so a source
comes near its target whatever its size and however many there are.  A source's k-th block has the quotient
target / (2k - 1); the highest quotients get the blocks.  Only blocks whose place is not settled by bounds on
the divisor are ranked, some six a source, so the cost does not grow with the number of blocks.  Laid end to end
in the order of sources the blocks are dealt to the shards in turn, so a shard's quota of every source
is an integer, a source's quotas differ by one at most, and so do the shards' sums.

A shard selects its quota from the source's documents in a seeded order, after the shards before it and
going round if the order ends; a block may end within a document, of which then only the words in the block count
as taken.  What is taken of a document is what the shards select of it.

Positions in the seeded order take two levels: documents are dealt to buckets by the
first digits of their seeded digest; bucket sums give each bucket its start, so a
source with a third of all rows is spread over as many tasks as there are buckets.
Windows without a partition run over rows by source, not by document.

Defined results: a null or empty text has size 0 and takes 0; a missing source is a source; rows that
repeat in full count one by one; an empty table gives an empty result; extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (5, 2, 1)
MOST = 3
SHARDS = 8
#: Blocks in the smallest target, if it has as many words.
FINE = 4096
SEED = "mix-1"


def features() -> dict[str, Column]:
    """Words and seeded digest of a document."""
    text = F.col("text").cast("string")
    return {
        "__size": F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long"),
        "__order": F.md5(F.concat_ws(":", F.lit(SEED), F.col("doc_id").cast("string"), F.md5(F.coalesce(text, F.lit(""))))),
    }


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, total, rank, target) from (source, source_size).

    The windows without a partition run over one row per source, not over documents.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))).withColumn("weight", weight.cast("long"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stop = Window.orderBy(F.col("source_size") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    levels = ranked.withColumns({
        "total": F.sum("source_size").over(everything),
        "left": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(stop), F.lit(0)),
        "gone": F.coalesce(F.sum(most * F.col("source_size")).over(stop), F.lit(0)),
    }).withColumn("level", (F.col("total") - F.col("gone")) / F.col("left"))
    # Levels fall and stops rise along the order: the first source that is not stopped has the level.
    open_ = F.when(most * F.col("source_size") / F.col("weight") > F.col("level"), F.struct(F.col("source_size") / F.col("weight"), "rank", "level"))
    levels = levels.withColumn("level", F.min(open_).over(everything)["level"])
    target = F.least((most * F.col("source_size")).cast("double"), F.col("level") * F.col("weight"))
    return levels.select("source", "source_size", "total", "rank", F.coalesce(target, F.lit(0.0)).alias("target"))


def apportion(target: DataFrame) -> DataFrame:
    """``target`` with blocks, the source's part of all ``n`` by highest quotients, and first, those of the sources before it."""
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # The divisor that gives n blocks is off the mean by half a block a source at most, which bounds every source's part.
    few = target.where("target > 0").withColumn("sway", F.count("*").over(everything) / F.col("n") / 2).withColumn("mean", F.col("target") * F.col("n") / F.col("total"))
    few = few.withColumns({
        "low": F.greatest(F.floor(F.col("mean") * (1 - F.col("sway")) - 0.5) - 1, F.lit(0)).cast("long"),
        "high": F.ceil(F.col("mean") * (1 + F.col("sway")) + 0.5).cast("long") + 1,
    }).withColumn("free", F.col("n") - F.sum("low").over(everything))
    claims = few.select("rank", "free", "target", F.explode(F.sequence("low", "high")).alias("k")).withColumn("quotient", F.col("target") / (2 * F.col("k") + 1))
    won = claims.withColumn("place", F.row_number().over(Window.orderBy(F.desc("quotient"), "rank"))).where("place <= free").groupBy("rank").agg(F.count("*").alias("won"))
    got = target.join(few.select("rank", "low"), "rank", "left").join(won, "rank", "left")
    blocks = got.withColumn("blocks", F.coalesce("low", F.lit(0)) + F.coalesce("won", F.lit(0))).drop("low", "won")
    return blocks.withColumn("first", F.coalesce(F.sum("blocks").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def bounds(shards: int = SHARDS) -> Column:
    """Blocks of a source (blocks, first) in the shards before each shard, and at last in all."""
    def below(place: Column, shard: Column) -> Column:
        return F.floor(place / shards) * shard + F.least(F.pmod(place, F.lit(shards)), shard)

    return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(shards).cast("long")), lambda s: below(F.col("first") + F.col("blocks"), s) - below(F.col("first"), s))


def quotas(target: DataFrame, shards: int, n: int) -> DataFrame:
    """(rank, shard, blocks): each shard's part of n blocks, by source."""
    dealt = apportion(target.withColumn("n", F.lit(n))).select("rank", F.posexplode(bounds(shards)).alias("shard", "end"))
    before = F.lag("end").over(Window.partitionBy("rank").orderBy("shard"))
    return dealt.select("rank", (F.col("shard") - 1).alias("shard"), (F.col("end") - before).alias("blocks")).where("blocks is not null")


def shares(rows: DataFrame) -> DataFrame:
    """(source, source_size, target, bounds) from rows with source and __size: the words of every source
    in the shards before each shard, and at last in all."""
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    target = targets(rows.groupBy("source").agg(F.sum("__size").alias("source_size")))
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(everything)
    target = target.withColumn("block", F.greatest(F.floor(F.coalesce(least, F.lit(0.0)) / FINE), F.lit(1)).cast("long")).withColumn("n", F.expr("total div block"))
    words = F.transform(bounds(), lambda b: F.least(b * F.col("block"), MOST * F.col("source_size")))
    return apportion(target).select("source", "source_size", "target", words.alias("bounds"))


def mixed(rows: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """``rows`` (with __size and __order) with __source_size, __target, __shard_words (words that each shard takes) and __taken.

    counted: the same rows if they can be read at less cost for the sums.
    """
    counted = rows if counted is None else counted
    bucket = F.substring("__order", 1, 3)
    sums = counted.groupBy("source", bucket.alias("__bucket")).agg(F.sum("__size").alias("words"))
    before = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "__bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("__start"))
    plan = starts.alias("a").join(shares(counted).alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select(
        F.col("a.source").alias("__of"), F.col("__bucket").alias("__in"), "__start", F.col("source_size").alias("__source_size"), F.col("target").alias("__target"),
        F.col("bounds").alias("__bounds"))
    within = Window.partitionBy("source", "__bucket").orderBy("__order", "doc_id", "__size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__bucket", bucket).withColumn("__done", F.coalesce(F.sum("__size").over(within), F.lit(0)))
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("__of")) & (F.col("__bucket") == F.col("__in")))
    at = F.col("__start") + F.col("__done")

    def overlap(shard: Column, turn: Column) -> Column:
        begin = turn * F.col("__source_size") + at
        return F.greatest(F.least(begin + F.col("__size"), F.get("__bounds", shard + 1)) - F.greatest(begin, F.get("__bounds", shard)), F.lit(0).cast("long"))

    def added(values: Column) -> Column:
        return F.aggregate(values, F.lit(0).cast("long"), lambda x, y: x + y)

    turns = F.array(*(F.lit(k).cast("long") for k in range(MOST)))
    by_shard = F.transform(F.sequence(F.lit(0), F.lit(SHARDS - 1)), lambda s: added(F.transform(turns, lambda k: overlap(s, k))))
    rows = rows.withColumn("__shard_words", by_shard).withColumn("__taken", added(F.col("__shard_words")))
    return rows.drop("__bucket", "__done", "__of", "__in", "__start", "__bounds")


def mix(docs: DataFrame) -> DataFrame:
    """``docs`` with every document as often as the mix takes it; one that is taken in part counts as
    whole from half its words on."""
    rows = docs.withColumns(features())
    out = mixed(rows)
    times = F.when(F.col("__size") > 0, F.round(F.col("__taken") / F.col("__size"))).otherwise(F.lit(0)).cast("int")
    return out.select(*docs.columns, F.explode(F.when(times > 0, F.sequence(F.lit(1), times))).alias("__n")).drop("__n")
