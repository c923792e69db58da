"""Dataset inventory, status log, incremental loads and fetch plans (IN-*, WN-03, WN-04, FL-12).

Parquet tables take no UPDATE, so a status change is an appended event; the
current state is the last event per dataset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidycell import schemas

# The states of a dataset, the priority range and its default.
STATUSES = ("pending", "processing", "completed", "failed")
PRIORITIES = (1, 10)
DEFAULT_PRIORITY = 5
EARLY_STOP = 0.95


def register(df: DataFrame, now) -> DataFrame:
    """IN-01: complete inventory rows from partial ones; rows without a required field are refused.

    The refused rows are those :func:`refused` returns.
    """
    for name in schemas.INVENTORY_REQUIRED:
        if name not in df.columns:
            raise ValueError(f"missing required column {name}")
    given = set(df.columns)
    defaults = {"total_records": F.lit(0), "created_at": F.lit(now), "updated_at": F.lit(now)}

    def value(name, type_):
        c = F.col(name) if name in given else defaults.get(name, F.lit(None))
        if type_ == "STRING" and name != "error_message":
            c = F.coalesce(c.cast("string"), F.lit(""))
        return c.cast(type_).alias(name)

    return df.filter(_complete()).select(*(value(n, t) for n, t in schemas.INVENTORY_COLUMNS))


def _complete() -> Column:
    ok = F.lit(True)
    for name in schemas.INVENTORY_REQUIRED:
        ok = ok & F.col(name).isNotNull()
    return ok


def refused(df: DataFrame) -> DataFrame:
    return df.filter(~_complete())


def status_events(df: DataFrame) -> DataFrame:
    """IN-02: status changes ready to append; the others are ``refused_events``."""
    return df.filter(_known_status())


def refused_events(df: DataFrame) -> DataFrame:
    """IN-02: status changes to an unknown or missing state, with the reason."""
    reason = F.when(F.col("status").isNull(), "no status").otherwise(F.concat(F.lit("unknown status "), "status"))
    return df.filter(~_known_status()).withColumn("reason", reason)


def _known_status() -> Column:
    return F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))


def latest(log: DataFrame, key: str, order: list) -> DataFrame:
    """WN-03: the last event per dataset; cut to one row per dataset in each task before the shuffle."""
    w = Window.partitionBy(key).orderBy(*order)
    return log.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def transitions(log: DataFrame, key: str, time: str, tie: str, span: str = "hour") -> DataFrame:
    """WN-04: every event with the status before it.

    The log of one dataset can be huge, so it is cut into calendar spans: the
    window runs within ``(dataset, span)``, and the first event of a span takes
    its predecessor from the last event of the dataset's previous non-empty span.
    Choose the span so that one span of the busiest dataset is a modest task;
    the result does not depend on it.
    """
    bucket = F.date_trunc(span, F.col(time).cast("timestamp"))
    spanned = log.withColumn("_span", bucket)
    inside = Window.partitionBy(key, "_span").orderBy(time, tie)
    previous = spanned.withColumns({
        "from_status": F.lag("status").over(inside),
        "_first": F.row_number().over(inside) == 1,
    })
    ends = spanned.groupBy(key, "_span").agg(F.max_by("status", F.struct(time, tie)).alias("_last"))
    across = Window.partitionBy(key).orderBy("_span")
    carried = ends.select(key, "_span", F.lag("_last").over(across).alias("_carried"))
    joined = previous.join(carried, [key, "_span"], "left")
    return joined.withColumn(
        "from_status", F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("from_status"))
    ).drop("_span", "_first", "_carried")


def listed(inventory: DataFrame, status: str | None = None, domain: str | None = None) -> DataFrame:
    """IN-03: datasets in a state and / or a domain."""
    if status is not None:
        inventory = inventory.filter(F.col("status") == status)
    if domain is not None:
        inventory = inventory.filter(F.col("domain") == domain)
    return inventory


def table_mapping(inventory: DataFrame) -> DataFrame:
    """IN-04: dataset to table name."""
    return inventory.select("dataset_id", "table_name")


def next_batch(inventory: DataFrame, n: int = 1, threshold: int = 0) -> DataFrame:
    """IN-05 / IN-06: pending datasets of sufficient priority, highest first, then as added."""
    pending = inventory.filter((F.col("status") == "pending") & (F.col("priority") >= threshold))
    return pending.orderBy(F.desc("priority"), "added_pos").limit(n)


def additions(new: DataFrame, inventory: DataFrame) -> DataFrame:
    """IN-07: datasets to add: known ids refused, the first of repeated ids kept, priority and domain made valid."""
    w = Window.partitionBy("id").orderBy("added_pos")
    fresh = new.join(inventory.select("id"), "id", "left_anti")
    first = fresh.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    low, high = PRIORITIES
    return first.withColumns({
        "priority": F.when(F.col("priority").between(low, high), F.col("priority")).otherwise(DEFAULT_PRIORITY),
        "domain": F.when(F.col("domain").isin(*schemas.DOMAINS), F.col("domain")).otherwise("generic"),
        "name": F.when(F.coalesce("name", F.lit("")) == "", F.concat(F.lit("Dataset "), F.col("id"))).otherwise(F.col("name")),
        "status": F.lit("pending"),
    })


def without(inventory: DataFrame, removed: DataFrame) -> DataFrame:
    """IN-08: the inventory after removal; write it to a new location, never over the one being read."""
    return inventory.join(removed.select("id"), "id", "left_anti")


def counts(inventory: DataFrame) -> DataFrame:
    """IN-09: number of datasets by status and by domain, long form, from one aggregation."""
    cube = inventory.groupBy("status", "domain").agg(F.count(F.lit(1)).alias("n"))
    sides = F.array(
        F.struct(F.lit("status").alias("dimension"), F.col("status").alias("label")),
        F.struct(F.lit("domain").alias("dimension"), F.col("domain").alias("label")),
    )
    pairs = cube.select(F.explode(sides).alias("s"), "n")
    return pairs.groupBy("s.dimension", "s.label").agg(F.sum("n").alias("datasets"))


def summary(inventory: DataFrame) -> DataFrame:
    """IN-09: total and one column per status, zero where there is none."""
    status = F.coalesce("status", F.lit("pending"))
    return inventory.agg(
        F.count(F.lit(1)).alias("total"), *(F.count_if(status == s).alias(s) for s in STATUSES)
    )


def throughput(log: DataFrame) -> DataFrame:
    """IN-10: load log with records per second."""
    return log.withColumn("records_per_second", F.try_divide(F.col("record_count"), F.col("duration_seconds")))


def changes(new: DataFrame, old: DataFrame, keys: list[str], value: str = "value", latest: str | None = None) -> DataFrame:
    """IN-11: rows of ``new`` that are absent from ``old`` or carry another value; one join tells both.

    Of a key that repeats in ``old`` the row with the greatest ``latest`` counts; without that column
    a key with several values differs from any new one.
    """
    known = (F.struct(F.max_by(value, latest)) if latest else F.when(
        (F.count(value) == F.count("*")) & (F.min(value) == F.max(value)) | (F.count(value) == 0), F.struct(F.min(value))))
    before = old.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(known.alias("_old"), F.lit(True).alias("_known"))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    joined = new.join(before, on, "left")
    change = F.when(F.col("_known").isNull(), "new").when(~F.struct(value).eqNullSafe(F.col("_old")), "changed")
    return (
        joined.withColumn("change", change).filter(F.col("change").isNotNull())
        .drop("_old", "_known", *(f"_{k}" for k in keys))
    )


def missing_chunks(plan: DataFrame, landed: DataFrame, keys: list[str]) -> DataFrame:
    """IN-13: planned chunks that did not land."""
    return plan.join(landed.select(*keys), keys, "left_anti")


def early_stop(periods: DataFrame, expected: DataFrame, share: float = EARLY_STOP) -> DataFrame:
    """IN-14: per dataset the periods to fetch, newest first, until ``share`` of the expected rows is reached.

    ``periods`` has one row per ``(dataset_id, year)`` with ``records``; ``expected`` is
    ``(dataset_id, expected)``.
    """
    before = Window.partitionBy("dataset_id").orderBy(F.desc("year")).rowsBetween(Window.unboundedPreceding, -1)
    running = periods.withColumn("fetched_before", F.coalesce(F.sum("records").over(before), F.lit(0).cast("bigint")))
    joined = running.join(expected, "dataset_id")
    return joined.filter(F.col("fetched_before") < F.col("expected") * share)
