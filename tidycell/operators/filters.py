"""Selection of cells (FL-01 .. FL-13, WN-05)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPTIONS_SHOWN = 20


def all_equal(conditions: dict) -> Column:
    """FL-01 / FL-10: every column equals its value."""
    return reduce(lambda a, b: a & b, (F.col(f"`{c}`") == F.lit(v) for c, v in conditions.items()), F.lit(True))


def non_null(column: str) -> Column:
    """FL-05."""
    return F.col(f"`{column}`").isNotNull()


def non_empty(column: str) -> Column:
    """FL-06: neither NULL nor empty text."""
    return F.col(f"`{column}`").isNotNull() & (F.col(f"`{column}`") != "")


def _first(codes: DataFrame, key: Column) -> DataFrame:
    """The code listed first for each ``(category, key)``; partial aggregation keeps a hot key small."""
    return (
        codes.groupBy("category_id", key.alias("wanted"))
        .agg(F.min(F.struct("code_pos", "code")).alias("hit"))
        .select("category_id", "wanted", F.col("hit.code").alias("code"))
    )


def _substrings(c: Column) -> Column:
    """All substrings of a short code, the empty one included."""
    n = F.length(c)
    starts = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    pieces = F.transform(
        starts, lambda i: F.transform(F.sequence(F.lit(0), n - i + 1), lambda k: F.substring(c, i, k))
    )
    return F.array_distinct(F.flatten(pieces))


def resolve(requests: DataFrame, codes: DataFrame) -> DataFrame:
    """FL-02 / WN-05: turn requested values into codes.

    ``requests`` holds ``(category_id, wanted)`` and anything else to carry;
    ``codes`` is the code list with ``code_pos``.  A label match beats a code
    match beats the first code that contains the text; unresolved requests get
    a NULL code.  ``match`` tells which one applied.

    All three lookups are equi-joins against one row per key: containment is
    looked up among the substrings of the codes, which are short, so no request
    is ever paired with every code of its category.
    """
    known = codes.filter((F.col("code") != "") & (F.col("name") != "")).select(
        "category_id", "code", "name", "code_pos"
    )
    pieces = known.select("category_id", "code", "code_pos", F.explode(_substrings(F.col("code"))).alias("piece"))
    lookups = {
        "label": _first(known, F.col("name")),
        "code": _first(known, F.col("code")),
        "partial": _first(pieces, F.col("piece")),
    }
    joined = requests
    for how, lookup in lookups.items():
        joined = joined.join(lookup.withColumnRenamed("code", f"_{how}"), ["category_id", "wanted"], "left")
    match = F.coalesce(*(F.when(F.col(f"_{how}").isNotNull(), F.lit(how)) for how in lookups))
    return joined.withColumns({
        "code": F.coalesce(*(F.col(f"_{how}") for how in lookups)),
        "match": match,
    }).drop(*(f"_{how}" for how in lookups))


def unknown_categories(requests: DataFrame, codes: DataFrame) -> DataFrame:
    """FL-03: requests whose category the dataset does not have."""
    return requests.join(codes.select("category_id").distinct(), "category_id", "left_anti")


def options(codes: DataFrame, shown: int = OPTIONS_SHOWN) -> DataFrame:
    """FL-02 / FL-03: the first codes of each category, offered when a value is not found."""
    first = Window.partitionBy("category_id").orderBy("code_pos", "code")
    return codes.withColumn("rn", F.row_number().over(first)).filter(F.col("rn") <= shown).drop("rn")


def apply_resolved(cells: DataFrame, resolved: DataFrame, categories: list[str]) -> DataFrame:
    """FL-01 after FL-02: keep the cells whose code was resolved, for each of the named categories."""
    for category_id in categories:
        wanted = resolved.filter(F.col("category_id") == category_id).select(F.col("code").alias(f"@{category_id}"))
        cells = cells.join(wanted, f"@{category_id}", "left_semi")
    return cells


def selectivity(df: DataFrame, condition: Column) -> DataFrame:
    """FL-04: kept and available rows, percent kept, and whether nothing was left, in one pass."""
    counts = df.agg(F.count_if(condition).alias("fetched"), F.count(F.lit(1)).alias("available"))
    return counts.select(
        "fetched", "available",
        (100 * F.try_divide("fetched", "available")).alias("percent"),
        (F.col("fetched") == 0).alias("is_empty"),
    )


def selected(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """FL-11 / JN-08: rows whose id is listed.

    If ``df`` is read from files partitioned by the column and ``ids`` is the outcome of a filter small enough to be
    broadcast, Spark lists the ids first and reads the files of no other partition (dynamic partition pruning).
    """
    return df.join(ids.select(F.col(column)), column, "left_semi")


def updated_since(datasets: DataFrame, last_ingestion: DataFrame) -> DataFrame:
    """FL-12: datasets whose source changed after (strictly) their last ingestion, or never ingested."""
    joined = datasets.join(last_ingestion, "dataset_id", "left")
    never = F.col("last_ingested_at").isNull()
    return joined.filter(never | (F.col("updated_at") > F.col("last_ingested_at")))


def custom_sql(spark: SparkSession, query: str, views: dict[str, DataFrame]) -> DataFrame:
    """FL-13: run a query over the given DataFrames.

    The text is run as a subquery, where the grammar admits nothing but a query:
    statements that write, define or set anything do not parse.
    """
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(f"SELECT * FROM (\n{query.strip().rstrip(';')}\n)")
