from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidycell.llm import token_counts
from tidycell.llm.common import table
from tidycell.llm.registry import query


@query("op1_token_counts")
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts.count(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("__tokens").alias("n_tokens"), F.col("__edits").alias("n_edits"),
                        F.col("__tokens_after").alias("n_tokens_after"), F.col("__again").alias("n_chars_again"))
