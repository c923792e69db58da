from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidycell.llm import jaccard_join
from tidycell.llm.common import table
from tidycell.llm.registry import query


@query("op2_ngram_jaccard_join")
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "copy_id", "class_id", "n_links")
