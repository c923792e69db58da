from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidycell.llm import shard
from tidycell.llm.common import stage, table
from tidycell.llm.registry import query


@query("op7_sharding")
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stage(table(spark, sf_dir, "documents").withColumns(shard.features()).select("doc_id", "__size", "__crc"), "shard")
    return shard.shuffled(rows).select(
        "doc_id", F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.lit("rows").alias("law"),
        F.col("__shard").alias("shard"), F.col("__slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
