"""The ingest error log (EL-01 .. EL-03)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Error types with their terms, in the order they are tried; and the types worth a retry.
ERROR_TERMS = (
    ("timeout_error", ("timeout",)),
    ("network_error", ("connection", "network", "unreachable")),
    ("api_error", ("api",)),
    ("data_error", ("json", "parse", "format", "invalid")),
    ("validation_error", ("validation",)),
    ("storage_error", ("s3", "storage", "bucket")),
)
CLASS_TERMS = ("timeout", "api", "validation")
UNKNOWN = "unknown_error"
RETRYABLE = ("api_error", "network_error", "timeout_error", "storage_error")


def error_type(message: Column, error_class: Column | None = None) -> Column:
    """EL-01: the first type one of whose terms occurs in the message, or (for some types) in the error class."""
    text = F.lower(F.coalesce(message, F.lit("")))
    kind = F.lower(F.coalesce(error_class, F.lit(""))) if error_class is not None else F.lit("")
    result = F.lit(UNKNOWN)
    for label, terms in reversed(ERROR_TERMS):
        hit = text.rlike("|".join(terms))
        for term in terms:
            if term in CLASS_TERMS:
                hit = hit | kind.contains(term)
        result = F.when(hit, label).otherwise(result)
    return result


def is_retryable(kind: Column) -> Column:
    """EL-02."""
    return kind.isin(*RETRYABLE)


def by_type(log: DataFrame) -> DataFrame:
    """EL-03: errors per type."""
    return log.groupBy("error_type").agg(F.count(F.lit(1)).alias("errors"), F.max("ts").alias("last_seen"))


def recent(log: DataFrame, n: int = 10) -> DataFrame:
    """EL-03: the last errors."""
    return log.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)
