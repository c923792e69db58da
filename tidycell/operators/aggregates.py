"""Grouped statistics over a tidy table (AG-01 .. AG-26, SL-*).

Every report is an aggregation with map-side combine followed, where the report
is a top list, by a TakeOrderedAndProject: no sort of the whole table.  Ties
are broken by the grouping key, so a top list is the same on every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidycell.functions import scalars as S

from tidycell.functions.stats import DIGITS, mean, merged, partial, spread, total

VALUE = "value"


def _rows(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)


def _with_value(df: DataFrame) -> DataFrame:
    return df.filter(F.col(VALUE).isNotNull())


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def _asc(*columns: str) -> list[Column]:
    return [F.asc_nulls_last(c) for c in columns]


def _desc(*columns: str) -> list[Column]:
    return [F.desc_nulls_last(c) for c in columns]


def total_count(df: DataFrame) -> DataFrame:
    """AG-01."""
    return df.agg(_rows("total_records"))


def value_statistics(df: DataFrame, digits=DIGITS) -> DataFrame:
    """AG-02: count, mean, extremes and sum of the non-null values."""
    return df.agg(
        F.count(VALUE).alias("count"), mean(VALUE, digits).alias("avg_value"),
        F.min(VALUE).alias("min_value"), F.max(VALUE).alias("max_value"), total(VALUE, digits).alias("sum_value"),
    )


def overview(df: DataFrame, digits=DIGITS) -> DataFrame:
    """AG-03: size, distinct datasets / years / regions, and value statistics.

    The rows are first reduced to one per (dataset, year, region); the distinct
    counts then run over that small table, instead of over a four-fold expansion
    of the input.
    """
    cells = df.groupBy("dataset_id", "year", "region_code").agg(
        _rows("n"), F.count(VALUE).alias("nv"), partial(VALUE).alias("s"),
        F.min(VALUE).alias("lo"), F.max(VALUE).alias("hi"),
    )
    return cells.agg(
        F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("record_count"),
        F.countDistinct("dataset_id").alias("unique_datasets"),
        F.countDistinct("year").alias("unique_years"),
        F.countDistinct("region_code").alias("unique_regions"),
        merged("s", digits).alias("total_value"),
        F.try_divide(merged("s", digits), F.sum("nv")).alias("avg_value"),
        F.min("lo").alias("min_value"), F.max("hi").alias("max_value"),
        F.min("year").alias("earliest_year"), F.max("year").alias("latest_year"),
    )


def value_spread(df: DataFrame, digits=DIGITS) -> DataFrame:
    """AG-04: non-null count, mean, extremes and sample standard deviation."""
    return df.agg(
        F.count(VALUE).alias("non_null_values"), mean(VALUE, digits).alias("avg_value"),
        F.min(VALUE).alias("min_value"), F.max(VALUE).alias("max_value"), spread(VALUE).alias("stddev_value"),
    )


def by_year(df: DataFrame, n: int = 10, digits=DIGITS) -> DataFrame:
    """AG-05: the first years with count and mean."""
    grouped = _with_value(df).groupBy("year").agg(_rows("count"), mean(VALUE, digits).alias("avg_value"))
    return top(grouped, n, *_asc("year"))


def by_region(df: DataFrame, n: int = 10, digits=DIGITS) -> DataFrame:
    """AG-06: the regions with the largest sums."""
    grouped = _with_value(df).groupBy("region_code").agg(
        _rows("count"), mean(VALUE, digits).alias("avg_value"), total(VALUE, digits).alias("sum_value")
    )
    return top(grouped, n, *_desc("sum_value"), *_asc("region_code"))


def by_category(df: DataFrame, column: str = "category", n: int = 10, digits=DIGITS) -> DataFrame:
    """AG-07: the most frequent categories."""
    grouped = _with_value(df).filter(F.col(column).isNotNull()).groupBy(column).agg(
        _rows("count"), mean(VALUE, digits).alias("avg_value")
    )
    return top(grouped, n, *_desc("count"), *_asc(column))


def yearly_range(df: DataFrame, digits=DIGITS) -> DataFrame:
    """AG-08: mean and extremes per year."""
    return _with_value(df).groupBy("year").agg(
        mean(VALUE, digits).alias("avg_value"), F.min(VALUE).alias("min_value"), F.max(VALUE).alias("max_value")
    ).orderBy(*_asc("year"))


def by_year_region(df: DataFrame, n: int = 100, digits=DIGITS) -> DataFrame:
    """AG-09: statistics per year and region, newest years first."""
    grouped = df.groupBy("year", "region_code").agg(
        _rows("record_count"), total(VALUE, digits).alias("total_value"), mean(VALUE, digits).alias("avg_value"),
        F.min(VALUE).alias("min_value"), F.max(VALUE).alias("max_value"),
    )
    return top(grouped, n, *_desc("year"), *_asc("region_code"))


def year_distribution(df: DataFrame, n: int = 10) -> DataFrame:
    """AG-10: rows per year, rows without a value included."""
    return top(df.groupBy("year").agg(_rows("count")), n, *_asc("year"))


def category_distribution(df: DataFrame, column: str = "category", n: int = 10) -> DataFrame:
    """AG-11: the most frequent non-empty categories."""
    kept = df.filter(F.col(column).isNotNull() & (F.col(column) != ""))
    return top(kept.groupBy(column).agg(_rows("count")), n, *_desc("count"), *_asc(column))


def by_year_category(df: DataFrame, column: str = "category", least: int = 10, n: int = 20, digits=DIGITS) -> DataFrame:
    """AG-12: mean per year and category where there are at least ``least`` values."""
    grouped = _with_value(df).groupBy("year", column).agg(
        mean(VALUE, digits).alias("avg_value"), _rows("sample_size")
    ).filter(F.col("sample_size") >= least)
    return top(grouped, n, *_asc("year"), *_desc("avg_value"), *_asc(column))


def yearly_trend(df: DataFrame, digits=DIGITS) -> DataFrame:
    """AG-13: mean, number and standard deviation per year."""
    return _with_value(df).groupBy("year").agg(
        mean(VALUE, digits).alias("yearly_average"), _rows("data_points"), spread(VALUE).alias("yearly_stddev")
    ).orderBy(*_asc("year"))


def outliers(df: DataFrame, order: list[str], threshold: float = 2.0, n: int = 10) -> DataFrame:
    """AG-14 / JN-06: values more than ``threshold`` standard deviations from the mean, farthest first.

    Mean and deviation come as one scalar subquery over a one-row aggregate;
    there is no join.
    """
    valued = _with_value(df)
    moments = valued.agg(F.struct(F.avg(VALUE).alias("m"), F.stddev_samp(VALUE).alias("s"))).scalar()
    score = F.try_divide(F.abs(F.col(VALUE) - moments["m"]), moments["s"])
    scored = valued.withColumn("z_score", score).filter(F.col("z_score") > threshold).withColumn("z_score", F.round("z_score", 6))
    return top(scored, n, *_desc("z_score"), *_asc(*order))


def dataset_profile(df: DataFrame, digits=DIGITS) -> DataFrame:
    """AG-15: per dataset: rows, distinct years, first and last year, non-null values, mean.

    Years are collapsed first, so a dataset that holds a third of the rows
    reaches the second step as one row per year.
    """
    years = df.groupBy("stats_data_id", "year").agg(_rows("n"), F.count(VALUE).alias("nv"), partial(VALUE).alias("s"))
    return years.groupBy("stats_data_id").agg(
        F.sum("n").alias("record_count"), F.count("year").alias("unique_years"),
        F.min("year").alias("min_year"), F.max("year").alias("max_year"),
        F.sum("nv").alias("non_null_values"),
        F.try_divide(merged("s", digits), F.sum("nv")).alias("avg_value"),
    ).orderBy(*_asc("stats_data_id"))


def latest_years(df: DataFrame, dataset: str, n: int = 10, digits=DIGITS) -> DataFrame:
    """AG-16: the newest yearly means of one dataset."""
    one = _with_value(df).filter(F.col("stats_data_id") == dataset)
    grouped = one.groupBy("year").agg(_rows("record_count"), mean(VALUE, digits).alias("avg_value"))
    return top(grouped, n, *_desc("year"))


def region_datasets(df: DataFrame, n: int = 10) -> DataFrame:
    """AG-17: the regions with most rows and how many datasets cover them."""
    pairs = df.groupBy("region_code", "stats_data_id").agg(_rows("n"))
    grouped = pairs.groupBy("region_code").agg(
        F.sum("n").alias("record_count"), F.count("stats_data_id").alias("datasets")
    )
    return top(grouped, n, *_desc("record_count"), *_asc("region_code"))


def per_dataset(df: DataFrame, column: str = "stats_data_id") -> DataFrame:
    """AG-18."""
    return df.groupBy(column).agg(_rows("record_count")).orderBy(*_desc("record_count"), *_asc(column))


def busiest_years(df: DataFrame, n: int = 10) -> DataFrame:
    """AG-19."""
    return top(df.groupBy("year").agg(_rows("record_count")), n, *_desc("record_count"), *_asc("year"))


def region_totals(df: DataFrame, year: int, n: int = 10, digits=DIGITS) -> DataFrame:
    """AG-20: the largest regions of one year, with their names."""
    grouped = df.filter(F.col("year") == year).groupBy("region_code", "region_name").agg(
        total(VALUE, digits).alias("total_value")
    )
    return top(grouped, n, *_desc("total_value"), *_asc("region_code", "region_name"))


def year_region_totals(df: DataFrame, category: str, column: str = "category", digits=DIGITS) -> DataFrame:
    """AG-21: year x region sums of one category."""
    return df.filter(F.col(column) == category).groupBy("year", "region_code").agg(
        total(VALUE, digits).alias("total_value")
    ).orderBy(*_asc("year", "region_code"))


def dataset_values(df: DataFrame, digits=DIGITS) -> DataFrame:
    """AG-22: per dataset: rows, mean and extremes of the non-null values."""
    return _with_value(df).groupBy("stats_data_id").agg(
        _rows("record_count"), mean(VALUE, digits).alias("avg_value"),
        F.min(VALUE).alias("min_value"), F.max(VALUE).alias("max_value"),
    ).orderBy(*_asc("stats_data_id"))


def age_profile(df: DataFrame, age: Column, population: Column, digits=DIGITS) -> DataFrame:
    """AG-23: youngest and oldest age, mean population per age, and the most populous age (youngest on a tie)."""
    ages = df.select(age.alias("age"), population.alias("population")).filter("age IS NOT NULL")
    return ages.agg(
        F.min("age").alias("min_age"), F.max("age").alias("max_age"),
        mean("population", digits).alias("mean_population"),
        F.max_by("age", F.struct(F.col("population"), -F.col("age"))).alias("peak_age"),
        F.max("population").alias("peak_population"),
    )


def split_shares(df: DataFrame, column: str, parts: dict[str, str], all_code: str, digits=DIGITS) -> DataFrame:
    """AG-24: total, one sum per part, and each part's share in percent."""
    code = F.col(f"`{column}`")
    one = df.agg(
        total(F.when(code == all_code, F.col(VALUE)), digits).alias("total"),
        *(total(F.when(code == part, F.col(VALUE)), digits).alias(name) for name, part in parts.items()),
    )
    return one.withColumns({f"{name}_percent": S.percent_of(name, "total") for name in parts})


def distinct_per_column(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """AG-25: number of distinct values of each dimension column.

    Exact counts run as one group-by per column over a single pass of
    ``(column, value)`` pairs, combined map-side.  ``approximate`` uses sketches
    and needs no shuffle of values at all.
    """
    if approximate:
        one = df.agg(*(F.approx_count_distinct(f"`{c}`").alias(c) for c in columns))
        pairs = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("distinct_values")) for c in columns))
        return one.select(F.explode(pairs).alias("p")).select("p.*")
    pairs = F.array(*(F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns))
    seen = df.select(F.explode(pairs).alias("p")).groupBy("p.c", "p.v").agg(_rows("n"))
    return seen.groupBy(F.col("c").alias("column_name")).agg(F.count("v").alias("distinct_values"))


# Groups of suggested terms in the order they are tried.
TERM_GROUPS = (
    ("所得・収入", ("所得", "賃金", "給与")),
    ("年齢・世代", ("年齢", "歳")),
    ("地域", ("都道府県", "市区町村")),
    ("就業・労働", ("就業", "雇用", "労働")),
    ("家族・世帯", ("世帯", "家族")),
    ("婚姻", ("婚姻", "配偶")),
    ("教育", ("教育", "学校")),
    ("住宅", ("住宅",)),
    ("産業", ("業",)),
)


def term_statistics(terms: DataFrame, column: str = "suggested", rules=TERM_GROUPS, otherwise: str = "その他") -> DataFrame:
    """AG-26: number of dictionary terms per group."""
    grouped = terms.groupBy(S.first_match(F.col(column), rules, otherwise).alias("category")).agg(_rows("term_count"))
    return grouped.orderBy(*_desc("term_count"), *_asc("category"))


