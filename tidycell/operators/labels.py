"""Code lists as a dimension table (PR-08, PR-10, JN-07, JN-09).

No join here is hinted.  Spark broadcasts the code list while its measured size
is under ``spark.sql.autoBroadcastJoinThreshold`` and shuffles otherwise, and
AQE splits skewed codes; a code list of any size is therefore safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidycell.functions.stats import merged, partial
from tidycell.session import scratch


def category(codes: DataFrame, category_id: str) -> DataFrame:
    """``(code, name)`` of one category; the last entry wins when a code is listed twice."""
    rows = codes.filter(F.col("category_id") == category_id)
    if "code_pos" in codes.columns:
        return rows.groupBy("code").agg(F.max_by("name", "code_pos").alias("name"))
    return rows.groupBy("code").agg(F.max("name").alias("name"))


def with_label(df: DataFrame, codes: DataFrame, category_id: str, column: str, label: str) -> DataFrame:
    """PR-08 / PR-10 / JN-07: add the label of a code column next to it, empty when unknown."""
    names = category(codes, category_id).select(F.col("code").alias("_code"), F.col("name").alias("_name"))
    joined = df.join(names, F.col(f"`{column}`") == F.col("_code"), "left")
    return joined.withColumn(label, F.coalesce("_name", F.lit(""))).drop("_code", "_name")


def with_labels(df: DataFrame, codes: DataFrame, columns: dict[str, str], suffix: str = "_name") -> DataFrame:
    """PR-10: labels of several code columns, ``{column: category}``, each next to its code."""
    for column, category_id in columns.items():
        df = with_label(df, codes, category_id, column, f"{column.lstrip('@')}{suffix}")
    return df


def with_parent(codes: DataFrame) -> DataFrame:
    """JN-09: every code next to its parent within the same category; NULL parent name at the top."""
    parent = codes.select(
        F.col("category_id").alias("_category"), F.col("code").alias("_code"),
        F.col("name").alias("parent_name"), F.col("level").alias("parent_level"),
    )
    on = (F.col("category_id") == F.col("_category")) & (F.col("parent_code") == F.col("_code"))
    return codes.join(parent, on, "left").drop("_category", "_code")


def children_per_parent(codes: DataFrame) -> DataFrame:
    """JN-09: number of direct children of each code."""
    children = (
        codes.filter(F.col("parent_code") != "")
        .groupBy("category_id", F.col("parent_code").alias("code"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    counted = codes.join(children, ["category_id", "code"], "left")
    return counted.withColumn("children", F.coalesce("n", F.lit(0).cast("bigint"))).drop("n")


def ancestors(codes: DataFrame, name: str = "hierarchy") -> DataFrame:
    """JN-09: ``(category_id, code, ancestor, distance)`` of every code and every code above it.

    Pairs are joined with themselves, which doubles the distance they reach, until none is new: a tree of
    depth d takes log2(d) rounds, each written once.  A code within a circle of parents comes out as its own
    ancestor.  A parent that is no code of its category counts as none.
    """
    spark = codes.sparkSession
    own = codes.select("category_id", F.col("code").alias("ancestor")).distinct()
    pairs = codes.where("parent_code <> ''").select("category_id", "code", F.col("parent_code").alias("ancestor")).distinct()
    pairs = staged(spark, pairs.join(own, ["category_id", "ancestor"]).select("category_id", "code", "ancestor", F.lit(1).cast("bigint").alias("distance")), name)
    n = pairs.count()
    while n:
        above = pairs.select("category_id", F.col("code").alias("ancestor"), F.col("ancestor").alias("_above"), F.col("distance").alias("_more"))
        further = pairs.join(above, ["category_id", "ancestor"]).select("category_id", "code", F.col("_above").alias("ancestor"), (F.col("distance") + F.col("_more")).alias("distance"))
        pairs = staged(spark, pairs.unionByName(further).groupBy("category_id", "code", "ancestor").agg(F.min("distance").alias("distance")), name)
        before, n = n, pairs.count()
        if n == before:
            break
    return pairs


def staged(spark, df: DataFrame, name: str) -> DataFrame:
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hierarchy(codes: DataFrame, separator: str = " > ") -> DataFrame:
    """JN-09: every code with its depth, the codes from the top down to it as ``path``, and whether a circle of parents
    stands above it (its path and depth are NULL then)."""
    above = ancestors(codes)
    circle = above.where("code = ancestor").select("category_id", F.col("code").alias("ancestor")).withColumn("_circle", F.lit(True))
    step = F.struct(F.negate("distance").alias("d"), F.col("ancestor").alias("c"))
    each = above.join(circle, ["category_id", "ancestor"], "left").groupBy("category_id", "code").agg(
        F.count("*").alias("_depth"), F.sort_array(F.collect_list(step)).alias("_steps"), F.max(F.coalesce("_circle", F.lit(False))).alias("_circle"))
    found = codes.join(each, ["category_id", "code"], "left")
    round_ = F.coalesce("_circle", F.lit(False))
    steps = F.concat(F.coalesce(F.transform("_steps", lambda s: s["c"]), F.array().cast("array<string>")), F.array("code"))
    return found.withColumns({
        "depth": F.when(~round_, F.coalesce("_depth", F.lit(0).cast("bigint"))), "path": F.when(~round_, F.array_join(steps, separator)), "circular": round_,
    }).drop("_depth", "_steps", "_circle")


def rolled_up(codes: DataFrame, values: DataFrame, value: str = "value") -> DataFrame:
    """JN-09: per code the number and exact total of the values ``(category_id, code, value)`` of it and of all codes below."""
    per_code = values.groupBy("category_id", "code").agg(F.count(value).alias("_n"), partial(value).alias("_s"))
    pairs = ancestors(codes).where("code <> ancestor").select("category_id", "code", "ancestor")
    pairs = pairs.unionByName(codes.select("category_id", "code", F.col("code").alias("ancestor")).distinct())
    totals = per_code.join(pairs, ["category_id", "code"]).groupBy("category_id", F.col("ancestor").alias("code")).agg(
        F.sum("_n").alias("n"), merged("_s").alias("total"))
    return codes.select("category_id", "code").distinct().join(totals, ["category_id", "code"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
