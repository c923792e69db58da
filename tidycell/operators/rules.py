"""Rules kept as a table: many terms at once, the first match winning (PR-14, AG-26)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM = 3


def rule_table(spark, rules) -> DataFrame:
    """(term, category, priority) of rules written as ``((category, (term, ...)), ...)``, the first tried first."""
    rows = [(term, category, k) for k, (category, terms) in enumerate(rules) for term in terms]
    return spark.createDataFrame(rows, "term string, category string, priority int")


def categorised(rows: DataFrame, rules: DataFrame, text: str, out: str, otherwise: str) -> DataFrame:
    """``rows`` with the category of the rule of least priority whose term occurs in the lower-cased text.

    ``rules`` is ``(term, category, priority)``; of rules with one priority the category that sorts first wins.
    Planning does not depend on the number of rules.  Distinct texts meet the terms by an equi-join on a term's first
    ``GRAM`` characters (a text that contains a term contains these) and are then checked whole.  Terms
    are compared as they are; a blank one never matches, and a null text counts as empty.
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    known = rules.where("term <> ''").select("term", "category", "priority", F.substring("term", 1, GRAM).alias("_fragment"))
    # At most GRAM lengths of fragments occur.
    lengths = sorted(r.n for r in known.select(F.length("_fragment").alias("n")).distinct().collect())
    texts = rows.select(low.alias("_text")).distinct()
    runs = [F.regexp_extract_all("_text", F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in lengths]
    parts = texts.select("_text", F.explode(F.array_distinct(F.flatten(F.array(*runs)) if runs else F.array().cast("array<string>"))).alias("_fragment"))
    found = parts.join(known, "_fragment").where(F.contains("_text", "term"))
    best = found.groupBy("_text").agg(F.min(F.struct("priority", "category")).alias("_rule"))
    joined = rows.withColumn("_text", low).join(best, "_text", "left")
    return joined.withColumn(out, F.coalesce(F.col("_rule")["category"], F.lit(otherwise))).drop("_text", "_rule")
