from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidycell.llm import url_filter
from tidycell.llm.common import table
from tidycell.llm.registry import query


def _fits(entry: str) -> str:
    host, _, path = entry.partition("/")
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}'))"


LONGEST = sorted(url_filter.RULES, key=lambda r: -len(r[0]))


@query("op3_url_filter", f"""
WITH u AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
)
SELECT page_id, host, path,
  CASE {' '.join(f"WHEN {_fits(e)} THEN '{e}'" for e, _ in LONGEST)} END AS rule,
  CASE {' '.join(f"WHEN {_fits(e)} THEN '{v}'" for e, v in LONGEST)} {' '.join(f"WHEN {_fits(e)} THEN 'block'" for e in url_filter.BLOCKED)} ELSE 'allow' END AS verdict
FROM u
""")
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), url_filter.entries(spark))
    return found.select("page_id", F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"), F.col("__verdict").alias("verdict"))
