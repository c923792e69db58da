"""Data quality (DQ-01 .. DQ-10, WN-01).

Checks over one table share one aggregate pass.  Duplicate checks aggregate
the keys first (map-side combined), so a key that holds a third of the rows
arrives as one partial count per task instead of as one huge group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidycell import schemas
from tidycell.functions import scalars as S

GATE_NULL_COLUMNS = ("dataset_id", "year", "value")
GATE_KEY_COLUMNS = ("dataset_id", "year", "region_code")
DETAILS_SHOWN = 10


def _name(c: str) -> Column:
    return F.col(f"`{c}`")


def is_blank(c: str) -> Column:
    """NULL, empty text or the text ``null``."""
    return F.coalesce(_name(c).cast("string"), F.lit("")).isin("", "null")


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    """SO-03: required names the table does not have, in the required order."""
    return [c for c in required if c not in set(df.columns)]


def required_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """DQ-01: one row ``(total_records, missing_columns, actual_columns, valid)``; an empty table is valid."""
    missing = missing_columns(df, required)
    strings = lambda names: F.array(*map(F.lit, names)).cast("array<string>")
    return df.agg(F.count(F.lit(1)).alias("total_records")).select(
        "total_records",
        F.when(F.col("total_records") == 0, strings([])).otherwise(strings(missing)).alias("missing_columns"),
        strings(sorted(df.columns)).alias("actual_columns"),
        ((F.col("total_records") == 0) | F.lit(not missing)).alias("valid"),
    )


def _long(one_row: DataFrame, names: list[str], label: str, value: str, keep=()) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(n).alias(label), _name(n).alias(value)) for n in names))
    return one_row.select(*keep, F.explode(pairs).alias("p")).select(*keep, f"p.{label}", f"p.{value}")


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """DQ-02: ``(column_name, null_count, total_records)`` of the columns that have blanks, in one pass."""
    one = df.agg(
        *(F.count_if(is_blank(c)).alias(c) for c in columns), F.count(F.lit(1)).alias("_total")
    )
    rows = _long(one, columns, "column_name", "null_count", keep=("_total",))
    return rows.filter("null_count > 0").select("column_name", "null_count", F.col("_total").alias("total_records"))


def range_reason(column: str, minimum=None, maximum=None) -> Column:
    """DQ-03: why a value is out of its inclusive range; NULL when it is fine, absent or not a number."""
    number = S.to_number(_name(column).cast("string"))
    reason = F.lit(None).cast("string")
    if maximum is not None:
        reason = F.when(number > maximum, F.lit(f"Above maximum ({maximum})")).otherwise(reason)
    if minimum is not None:
        reason = F.when(number < minimum, F.lit(f"Below minimum ({minimum})")).otherwise(reason)
    return reason


def out_of_range(df: DataFrame, column: str, minimum=None, maximum=None) -> DataFrame:
    """DQ-03: ``(total_records, out_of_range_count, valid)``."""
    reason = range_reason(column, minimum, maximum)
    return df.agg(
        F.count(F.lit(1)).alias("total_records"), F.count(reason).alias("out_of_range_count")
    ).withColumn("valid", F.col("out_of_range_count") == 0)


def range_offenders(
    df: DataFrame, column: str, order: list, minimum=None, maximum=None, shown: int = DETAILS_SHOWN
) -> DataFrame:
    """DQ-03: the first offending rows in ``order`` with their reason."""
    reasoned = df.withColumn("reason", range_reason(column, minimum, maximum))
    return reasoned.filter(F.col("reason").isNotNull()).orderBy(*order).limit(shown)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """DQ-04: every key that occurs more than once, with its ``count``; NULL equals NULL."""
    return df.groupBy(*map(_name, keys)).agg(F.count(F.lit(1)).alias("count")).filter("count > 1")


def duplicate_texts(df: DataFrame, column: str) -> DataFrame:
    """DQ-04 for a key of long text: every text that occurs more than once, with its ``count``.

    Only 64-bit digests are shuffled for all rows; the texts themselves travel
    only where a digest repeats, and are then compared in full.
    """
    hashed = df.select(_name(column), F.xxhash64(_name(column)).alias("_h"))
    repeated = hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_h")
    suspects = hashed.join(repeated, "_h", "left_semi")
    return duplicate_keys(suspects, [column])


def duplicate_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """DQ-04: ``(duplicate_count, total_duplicate_records, total_records, has_duplicates)``."""
    counts = df.groupBy(*map(_name, keys)).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.count_if(F.col("n") > 1).alias("duplicate_count"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).cast("bigint").alias("total_duplicate_records"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_records"),
    ).withColumn("has_duplicates", F.col("duplicate_count") > 0)


def duplicate_details(df: DataFrame, keys: list[str], shown: int = DETAILS_SHOWN) -> DataFrame:
    """DQ-04: the most repeated keys."""
    order = [F.desc("count"), *(F.asc_nulls_last(f"`{k}`") for k in keys)]
    return duplicate_keys(df, keys).orderBy(*order).limit(shown)


def with_reasons(df: DataFrame, rules: dict[str, Column], unique: list[str] | None = None) -> DataFrame:
    """DQ-05: add ``reasons``, the names of all rules (conditions for bad rows) a row breaks.

    ``unique`` adds the reason ``duplicate`` to every row whose key is shared.
    Only the repeated keys are joined back; Spark broadcasts them while they are
    small, and AQE splits the hot key's rows on the other side otherwise.
    """
    checks = dict(rules)
    if unique:
        shared = duplicate_keys(df, unique).select(*(_name(k).alias(f"_k{i}") for i, k in enumerate(unique)))
        shared = shared.withColumn("_shared", F.lit(True))
        on = reduce(lambda a, b: a & b, (_name(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(unique)))
        df = df.join(shared, on, "left").drop(*(f"_k{i}" for i in range(len(unique))))
        checks["duplicate"] = F.col("_shared").isNotNull()
    reasons = F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in checks.items())))
    return df.withColumn("reasons", reasons).drop("_shared")


def quarantine(df: DataFrame, rules: dict[str, Column], unique: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """DQ-05: ``(valid, invalid)``; together they hold exactly the input rows, invalid ones with ``reasons``.

    Two lazy views of one annotated table: stage it first when both are written.
    """
    reasoned = with_reasons(df, rules, unique)
    return reasoned.filter(F.size("reasons") == 0).drop("reasons"), reasoned.filter(F.size("reasons") > 0)


def gate(df: DataFrame, required: list[str], check_duplicates: bool = False) -> DataFrame:
    """DQ-06: one row telling whether a mapped dataset may be loaded.

    Null counts and the duplicate summary come from the same aggregation: rows
    are counted per key first, and the key counts are then summed up.
    """
    missing = missing_columns(df, required)
    present = [c for c in GATE_NULL_COLUMNS if c in df.columns]
    blanks = [F.count_if(is_blank(c)).alias(f"null_{c}") for c in present]
    rows = F.count(F.lit(1)).alias("n")
    if check_duplicates:
        per_key = df.groupBy(*GATE_KEY_COLUMNS).agg(rows, *blanks)
    else:
        per_key = df.agg(rows, *blanks)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    summed = per_key.agg(
        total("n").alias("total_records"),
        *(total(f"null_{c}").alias(f"null_{c}") for c in present),
        (F.count_if(F.col("n") > 1) if check_duplicates else F.lit(0).cast("bigint")).alias("duplicate_keys"),
    )
    clean = reduce(lambda a, b: a & b, (F.col(f"null_{c}") == 0 for c in present), F.lit(True))
    return summed.withColumns({
        "missing_columns": F.lit(len(missing)),
        "valid": ((F.col("total_records") == 0) | F.lit(not missing)) & clean & (F.col("duplicate_keys") == 0),
    })


def completeness(fetched: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """DQ-07 / DQ-08: rows per dataset against the expected number; ratio 0 when nothing is expected.

    A ratio above 1 is a duplication factor.
    """
    counts = fetched.groupBy(key).agg(F.count(F.lit(1)).alias("fetched"))
    joined = expected.select(key, F.col("expected").cast("bigint")).join(counts, key, "left")
    got = F.coalesce("fetched", F.lit(0).cast("bigint"))
    return joined.select(
        key, "expected", got.alias("fetched"),
        F.coalesce(F.try_divide(got, F.col("expected")), F.lit(0.0)).alias("ratio"),
    )


def summary(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """DQ-09: ``(rule, failures, total)`` of all rules in one pass."""
    names = list(rules)
    one = df.agg(*(F.count_if(bad).alias(n) for n, bad in rules.items()), F.count(F.lit(1)).alias("total"))
    return _long(one, names, "rule", "failures", keep=("total",))


def registry(spark: SparkSession) -> DataFrame:
    """DQ-10 / SO-04: the schemas as rows ``(domain, column_name, type, role)``."""
    rows = [
        (domain, name, type_, "measure" if name == "value" else "dimension", name in schemas.partition_columns(domain))
        for domain in schemas.DOMAINS
        for name, type_ in schemas.columns(domain)
    ]
    return spark.createDataFrame(
        rows, "domain string, column_name string, type string, role string, is_partition boolean"
    )


def schema_verdicts(registered: DataFrame, held: DataFrame) -> DataFrame:
    """DQ-10: every registered column with what a table holds, ``(domain, column_name, held, filled)``:
    ``ok``, ``missing`` or ``type`` for another type than registered."""
    both = registered.join(held, ["domain", "column_name"], "left")
    verdict = F.when(F.col("held").isNull(), "missing").when(F.lower("type") != F.col("held"), "type").otherwise("ok")
    return both.withColumn("verdict", verdict)


def schema_conflicts(registered: DataFrame) -> DataFrame:
    """SO-04: columns that carry different types in different domains."""
    return registered.groupBy("column_name").agg(F.countDistinct("type").alias("types")).filter("types > 1")


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """WN-01 / ST-02: the first row of every key; NULL equals NULL.

    Spark cuts each task's rows to one per key before the shuffle
    (WindowGroupLimit), so copies of one key never gather in a single task.
    """
    w = Window.partitionBy(*map(_name, keys)).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
