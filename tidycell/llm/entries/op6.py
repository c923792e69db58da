from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidycell.llm import mixture
from tidycell.llm.common import stage, table
from tidycell.llm.registry import query

S = mixture.SHARDS


def _bound(s: int) -> str:
    """Words of a source in the shards before s."""
    def below(place: str) -> str:
        return f"(({place}) // {S} * {s} + least(({place}) % {S}, {s}))"

    return f"least(block * ({below('first_ + blocks')} - {below('first_')}), {mixture.MOST} * source_size) AS b{s}"


def _taken(s: int) -> str:
    """Words that shard s takes of a document, over all turns."""
    return " + ".join(f"greatest(0, least({k} * source_size + done + size, b{s + 1}) - greatest({k} * source_size + done, b{s}))" for k in range(mixture.MOST))


@query("op6_source_mixture", f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    md5(concat_ws(':', '{mixture.SEED}', CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS ord
  FROM documents
),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rnk FROM d GROUP BY source),
w AS (SELECT *, CASE (rnk - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s),
l AS (
  SELECT *, (total - coalesce(sum({mixture.MOST} * source_size) OVER stop, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER stop, 0)) AS lev
  FROM w WINDOW stop AS (ORDER BY source_size / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
t AS (
  SELECT source, source_size, total, rnk, least(CAST({mixture.MOST} * source_size AS DOUBLE), weight * (
    SELECT arg_min(lev, k) FROM (SELECT lev, row_number() OVER (ORDER BY source_size / weight, rnk) AS k, {mixture.MOST} * source_size / weight > lev AS free FROM l) WHERE free)) AS target
  FROM l
),
z AS (SELECT *, CAST(greatest(floor(coalesce(min(target) FILTER (target > 0) OVER (), 0) / {mixture.FINE}), 1) AS BIGINT) AS block, count(*) OVER () AS sources FROM t),
q AS (SELECT rnk, n, target / (2 * k + 1) AS quotient
  FROM (SELECT rnk, target, total // block AS n, unnest(range(0, CAST(ceil(target / total * (total // block + sources) + 2) AS BIGINT))) AS k FROM z WHERE target > 0)),
b AS (SELECT rnk, count(*) AS blocks FROM (SELECT rnk, n, row_number() OVER (ORDER BY quotient DESC, rnk) AS place FROM q) WHERE place <= n GROUP BY rnk),
f AS (SELECT z.* , coalesce(b.blocks, 0) AS blocks, CAST(coalesce(sum(b.blocks) OVER (ORDER BY rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_ FROM z LEFT JOIN b USING (rnk)),
p AS (SELECT source, source_size, target, {', '.join(map(_bound, range(S + 1)))} FROM f),
o AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY ord, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS done FROM d),
x AS (SELECT doc_id, size, source_size, target, {', '.join(f"{_taken(s)} AS s{s}" for s in range(S))} FROM o JOIN p ON o.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST({' + '.join(f's{s}' for s in range(S))} AS BIGINT) AS taken, concat_ws(',', {', '.join(f's{s}' for s in range(S))}) AS shard_words
FROM x
""")
def op6_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stage(table(spark, sf_dir, "documents").withColumns(mixture.features()).select("doc_id", "source", "__size", "__order"), "mixture")
    return mixture.mixed(rows).select(
        "doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__taken").alias("taken"), F.array_join("__shard_words", ",").alias("shard_words"))
