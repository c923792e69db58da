"""The named analyses of a table: one typed DataFrame per report."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidycell.operators import aggregates as A


def analyze(df: DataFrame, kind: str = "basic", category: str = "category") -> dict[str, DataFrame]:
    """``basic``, ``advanced`` or ``statistical`` reports; nothing runs until a report is used."""
    if kind == "basic":
        return {
            "overview": A.overview(df),
            "total_records": A.total_count(df),
            "statistics": A.value_statistics(df.filter("value IS NOT NULL")),
            "by_year": A.by_year(df),
        }
    if kind == "advanced":
        return {
            "by_year_region": A.by_year_region(df),
            "by_region": A.by_region(df),
            "by_category": A.by_category(df, category),
            "trend": A.yearly_range(df),
        }
    if kind == "statistical":
        return {
            "value_spread": A.value_spread(df),
            "year_distribution": A.year_distribution(df),
            "category_distribution": A.category_distribution(df, category),
            "by_year_category": A.by_year_category(df, category),
            "trend": A.yearly_trend(df),
            "outliers": A.outliers(df, ["stats_data_id", "year", category]),
        }
    raise ValueError(f"unknown analysis {kind!r}")
