"""Joins of tidy tables (JN-01 .. JN-06) and concatenation (SO-01, SO-02).

No join carries a broadcast hint: Spark broadcasts a side whose measured size
is below the threshold and otherwise shuffles both, with AQE splitting skewed
keys.  Joins on ``(year, region_code)`` take a *series* on the looked-up side,
one row per key, so no key can multiply rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidycell.functions.stats import DIGITS, total

KEYS = ["year", "region_code"]


def series(df: DataFrame, name: str, keys: list[str] = KEYS, digits=DIGITS) -> DataFrame:
    """One value per key: the sum of a table's measure."""
    return df.groupBy(*keys).agg(total("value", digits).alias(name))


def one_row_per_key(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The same rows; a repeated key is an error.  Grouped by the join's keys, it adds no shuffle to a join."""
    only = lambda c: F.when(F.count("*") == 1, F.first(c)).otherwise(F.raise_error(F.lit(f"several rows for one {', '.join(keys)}")))
    return df.groupBy(*keys).agg(*(only(c).alias(c) for c in df.columns if c not in keys))


def join_series(left: DataFrame, right: DataFrame, how: str = "inner", keys: list[str] = KEYS) -> DataFrame:
    """JN-01 / JN-02: rows of ``left`` with the matching value of the series ``right``, in which a key may not repeat."""
    return left.join(one_row_per_key(right, keys), keys, how)


def join_all(parts: list[DataFrame], keys: list[str] = KEYS) -> DataFrame:
    """JN-04: several series side by side; all are partitioned by the same keys, so each is shuffled once."""
    return reduce(lambda a, b: a.join(one_row_per_key(b, keys), keys, "inner"), parts)


def joined_statistics(left: DataFrame, right: DataFrame, digits=DIGITS) -> DataFrame:
    """JN-03: per year, over all pairs of rows that share year and region:
    distinct regions, sum of the left values, mean of the right values.

    The pairs are never built.  Each side is reduced to counts and sums per key;
    a left value occurs once per matching right row and the other way round, so
    the sums over pairs are products of the reduced figures.
    """
    lhs = left.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("ln"), total("value", digits).alias("ls"))
    rhs = right.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("rn"), F.count("value").alias("rv"), total("value", digits).alias("rs")
    )
    both = lhs.join(rhs, KEYS, "inner")
    return both.groupBy("year").agg(
        F.count("region_code").alias("region_count"),
        total(F.col("ls") * F.col("rn"), digits).alias("left_total"),
        F.try_divide(total(F.col("rs") * F.col("ln"), digits), F.sum(F.col("rv") * F.col("ln"))).alias("right_avg"),
    ).orderBy(F.asc_nulls_last("year"))


def inventory_counts(inventory: DataFrame, facts: DataFrame, table_name: str) -> DataFrame:
    """JN-05: the datasets registered for a table with the number of its rows.

    Pairing every dataset with every row and counting gives (registrations x
    rows); the row count is a scalar subquery instead.
    """
    rows = facts.agg(F.count(F.lit(1)).alias("n")).scalar()
    grouped = inventory.filter(F.col("table_name") == table_name).groupBy("dataset_id", "dataset_name", "domain").agg(
        F.count(F.lit(1)).alias("registrations")
    )
    counted = grouped.select("dataset_id", "dataset_name", "domain", (F.col("registrations") * rows).alias("record_count"))
    return counted.filter("record_count > 0")


def with_statistics(df: DataFrame, column: str = "value") -> DataFrame:
    """JN-06: every row with the mean and the deviation of its table, from one scalar subquery."""
    moments = df.agg(F.struct(F.avg(column).alias("m"), F.stddev_samp(column).alias("s"))).scalar()
    return df.withColumns({"mean_val": moments["m"], "std_val": moments["s"]})


def concatenate(chunks: list[DataFrame], label: str = "chunk_num") -> DataFrame:
    """SO-01: chunks one after another; their order is kept as a column."""
    numbered = [c.withColumn(label, F.lit(i)) for i, c in enumerate(chunks)]
    return reduce(lambda a, b: a.unionByName(b), numbered)


def union_tables(tables: list[DataFrame]) -> DataFrame:
    """SO-02: datasets of one domain as one table; a missing or extra column is an error."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=False), tables)




def common_columns(a: DataFrame, b: DataFrame) -> DataFrame:
    """SO-04: the columns two tables share: whether their types agree, and how many values both hold together."""
    types = {f.name: f.dataType for f in b.schema}
    shared = [f for f in a.schema if f.name in types]
    counts = union_tables([
        df.agg(*(F.count(f.name).alias(f.name) for f in shared)) for df in (a, b)
    ])
    pairs = F.array(*(
        F.struct(
            F.lit(f.name).alias("column_name"), F.lit(f.dataType == types[f.name]).alias("same_type"),
            F.col(f.name).alias("filled"),
        )
        for f in shared
    ))
    rows = counts.select(F.explode(pairs).alias("p")).select("p.*")
    return rows.groupBy("column_name", "same_type").agg(F.sum("filled").alias("filled"))
