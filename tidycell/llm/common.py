"""Row identity, staged tables and connected components for the operators here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidycell.session import scratch

NO_ID = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table once below the shared folder and read it from there, so that later steps do not
    compute it again and survive the loss of an executor."""
    spark = df.sparkSession
    path = scratch(spark, f"llm-{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def doc_key(doc_id: str = "doc_id") -> Column:
    """The document's place in the order of ids: a missing id comes last."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))


def keyed(docs: DataFrame) -> DataFrame:
    """(_doc, _key, text): a row is known by its id and a digest of its text, so rows that repeat in
    full are one document and rows that share only the id are ordered by the digest."""
    return docs.select(doc_key().alias("_doc"), F.xxhash64("text").alias("_key"), F.col("text").cast("string").alias("text"))


def id_of(doc: str | Column) -> Column:
    c = F.col(doc) if isinstance(doc, str) else doc
    return F.nullif(c, F.lit(NO_ID))


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) of an undirected graph given as edges (a, b) of longs: root is the smallest node of
    the component.  Alternating large-star and small-star steps, each written to the shared folder;
    a step only takes minima per node and joins them back, so a hub is never gathered in one task.
    """
    spark = edges.sparkSession

    def spread(pairs: DataFrame) -> DataFrame:
        """(u, v, m): the edges with the smallest node among u and its neighbours."""
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
        return pairs.join(least.select(F.col("u"), F.least("u", "m").alias("m")), "u")

    now = stage(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    seen = None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = spread(both).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        met = spread(down)
        now = stage(met.select(F.col("v").alias("a"), F.col("m").alias("b")).union(met.select(F.col("u").alias("a"), F.col("m").alias("b")))
                    .where("a != b").distinct(), name)
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == seen:
            break
        seen = mark
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
