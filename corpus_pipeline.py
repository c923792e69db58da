"""From raw documents to a sharded training mixture: five stages, each written and read again.

Defined results: a null, empty or short text fails the quality rules; a missing id or source is a value of its own; rows that repeat in
full are near duplicates, of which one stays; no text is too long for a stage; an empty table gives an empty result; other columns of documents stay, and
shard and slot are renamed if documents has such columns.  Names that begin with two underscores are the operators' own.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents.  ORACLE_SQL is None: shingle similarity over components and the
seeded shuffle have no plain SQL form; tests hold the stages against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidycell.llm import decontaminate, jaccard_join, mixture, quality, shard
from tidycell.llm.common import stage, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules, or the rules and their host, reject go."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a shingle similarity of 0.8 or more one stays."""
    return jaccard_join.survivors(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target asks for."""
    return mixture.mix(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with shard and slot."""
    return shard.shard(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixture", source_mixture),
    ("sharding", sharding),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, name)
    return docs
