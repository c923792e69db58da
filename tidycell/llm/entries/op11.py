from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidycell.llm import token_alignment
from tidycell.llm.common import stage, table
from tidycell.llm.registry import query


@query("op11_token_alignment")
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_alignment.groups(table(spark, sf_dir, "documents"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    kept = stage(found.select("doc_id", "n_a", "n_b", "n_groups", F.size("links").cast("long").alias("n_links"), digest.alias("groups_sha256"), "links"), "alignment")
    out = token_alignment.scored(kept, token_alignment.pair_counts(kept))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
