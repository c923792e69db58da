from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidycell.llm import periodic_runs
from tidycell.llm.common import table
from tidycell.llm.registry import query


def repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, text): documents whose crc32 ends in 0 repeat a stretch of their words from a word on, as the query asks."""
    h = F.crc32(F.col("doc_id").cast("string"))
    hit = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")).alias("w"))
    n, g = F.size("w"), F.floor(F.col("h") / 10)
    hit = hit.select("doc_id", "text", "w", n.alias("n"), g.alias("g"), F.when(n > 0, (g % n).cast("int")).alias("a"))
    hit = hit.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    period: Column = F.slice("w", F.col("a") + 1, F.col("p"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(period, times)), F.lit(1), F.col("n") - F.col("a"))
    text = F.when(F.col("a").isNull(), F.col("text")).otherwise(F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " "))
    return hit.select("doc_id", text.alias("text"))


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.detect(repeated(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.col("strongest")
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.start.alias("start"), best.length.alias("length"), best.period.alias("period"),
        F.expr("1000L * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
