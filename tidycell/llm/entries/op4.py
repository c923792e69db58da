from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidycell.llm import quality
from tidycell.llm.common import stage, table
from tidycell.llm.registry import query

DOUBTFUL = "(10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_dup_lines > n_words)"


@query("op4_quality_rules", f"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS lines
  FROM documents
),
x AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 4), ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
r AS (
  SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (
    SELECT doc_id, unnest(range(i, i + 5)) AS j FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM x) WHERE n > 1) GROUP BY doc_id
),
c AS (
  SELECT d.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '{quality.SYMBOLS}', '')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN r USING (doc_id)
),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c),
h AS (SELECT source, count(*) AS docs, sum(CAST(base_failed OR {DOUBTFUL} AS BIGINT)) AS failures FROM f GROUP BY source),
p AS (SELECT avg(failures / docs) AS mean, var_samp(failures / docs) AS v FROM h),
s AS (SELECT mean, greatest(coalesce(mean * (1 - mean) / CASE WHEN v > 0 THEN v END - 1, 1e9), 1e-3) AS strength FROM p),
k AS (SELECT source, (failures + mean * strength) / (docs + strength) > {quality.SUSPECT} AS host_suspect FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (host_suspect AND {DOUBTFUL}) AS kept, host_suspect
FROM f JOIN k ON f.source IS NOT DISTINCT FROM k.source
""")
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = stage(quality.counts(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text"), "quality")
    found = quality.verdicts(counted, quality.hosts(counted))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return found.select("doc_id", *(F.col(f"__{c}").alias(c) for c in names), F.col("__suspect").alias("host_suspect"))
