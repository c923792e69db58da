"""End-to-end ingest of a dataset (IN-12) and of a batch of them (IN-06): map, check, split, load, log."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable
from dataclasses import dataclass, replace
from urllib.parse import quote

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidycell import schemas
from tidycell.operators import domains, errors, inventory, quality
from tidycell.sources import tables, wire


@dataclass(frozen=True)
class Report:
    """What one ingest did; ``valid`` says whether no row had to be set aside.

    rows = loaded + revised + present + copies + quarantined.
    """

    dataset_id: str
    domain: str
    rows: int
    loaded: int
    quarantined: int
    table_path: str
    quarantine_path: str
    seconds: float = 0.0
    revised: int = 0
    present: int = 0
    copies: int = 0
    written_bytes: int = 0
    rejected: int = 0

    @property
    def valid(self) -> bool:
        return self.quarantined == 0

    def as_row(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(self.dataset_id, self.domain, self.rows, self.loaded, self.revised, self.present, self.copies, self.quarantined, self.valid)],
            "dataset_id string, domain string, rows bigint, loaded bigint, revised bigint, present bigint, copies bigint, "
            "quarantined bigint, valid boolean",
        )


def default_rules() -> dict:
    """Rows without a dataset, a year or a value are set aside."""
    return {f"missing_{c}": quality.is_blank(c) for c in quality.GATE_NULL_COLUMNS}


def ingest(
    spark: SparkSession, cells: DataFrame, domain: str, dataset_id: str, root: str,
    codes: DataFrame | None = None, rules: dict | None = None, updated_at=None, on_bad: str = "null", batch: str = "all",
) -> Report:
    """Parse once, annotate once, write twice: good rows to the table, bad ones to quarantine.

    The annotated rows are staged, so both writes read one copy; rows and bad rows are observed by the staging write.
    Good rows go through the idempotent load: rerunning an ingest adds nothing.
    The quarantine is kept per dataset and ``batch`` (name a chunk to ingest in chunks): a
    rerun of a batch puts its outcome in the place of the last one, also if nothing is set aside any more.
    """
    mapped = domains.to_domain(
        domains.with_identity(cells), domain, dataset_id, codes, on_bad=on_bad, updated_at=updated_at, keep=(tables.CELL_KEY,))
    start = time.monotonic()
    seen = Observation()
    reasoned = quality.with_reasons(mapped, rules if rules is not None else default_rules()).observe(
        seen, F.count(F.lit(1)).alias("n"), F.count_if(F.size("reasons") > 0).alias("bad"))
    reasoned = tables.stage(spark, reasoned, f"ingest-{dataset_id}")
    counts = seen.get
    table_path = tables.location(root, schemas.resolve(domain))
    quarantine_path = f"{root.rstrip('/')}/quarantine/{schemas.resolve(domain)}"
    load = tables.load_new(spark, reasoned.filter(F.size("reasons") == 0).drop("reasons"), table_path, domain)
    bad = reasoned.filter(F.size("reasons") > 0)
    if load.conflicting is not None:
        bad = bad.unionByName(load.conflicting.withColumn("reasons", F.array(F.lit("conflicting_value"))))
    set_aside(bad, quarantine_path, dataset_id, batch)
    report = Report(
        dataset_id, domain, counts["n"], load.loaded, counts["bad"] + load.conflicts, table_path, quarantine_path,
        time.monotonic() - start, load.revised, load.present, load.copies, load.written_bytes,
    )
    if report.rows != report.loaded + report.revised + report.present + report.copies + report.quarantined:
        raise RuntimeError(f"rows of {dataset_id} are unaccounted for: {report}")
    return report


def ingest_documents(
    spark: SparkSession, documents: DataFrame, domain: str, dataset_id: str, root: str, batch: str = "all", text: str = "value", **options,
) -> Report:
    """SC-16 / IN-12: ingest landed documents; those that report an error, carry no data or are damaged are
    kept with a reason below ``rejected`` and counted in the report, instead of passing as documents without cells."""
    bad = wire.rejected_documents(documents, text)
    folder = _folder(f"{root.rstrip('/')}/rejected/{schemas.resolve(domain)}", dataset_id, batch)
    bad.write.mode("overwrite").parquet(folder)
    report = ingest(spark, wire.cells(wire.accepted_documents(documents, text), text), domain, dataset_id, root, batch=batch, **options)
    return replace(report, rejected=spark.read.schema(bad.schema).parquet(folder).count())


def _folder(path: str, dataset_id: str, batch: str) -> str:
    return f"{path.rstrip('/')}/quarantined_dataset={quote(dataset_id, safe='')}/batch={quote(batch, safe='')}"


def set_aside(bad: DataFrame, path: str, dataset_id: str, batch: str) -> None:
    """Write a batch's quarantine in the place of its last one."""
    bad.drop(tables.CELL_KEY).write.mode("overwrite").parquet(_folder(path, dataset_id, batch))


# Columns of the load log, the status log and the error log.
LOAD_LOG = "dataset_id string, domain string, ts timestamp, record_count bigint, duration_seconds double, storage_bytes bigint"
STATUS_LOG = "dataset_id string, status string, ts timestamp, error_message string"


def log_load(spark: SparkSession, report: Report, path: str, at: dt.datetime) -> None:
    """IN-10: append what an ingest loaded, how long it took and how many bytes it wrote."""
    row = (report.dataset_id, report.domain, at, report.loaded, report.seconds, report.written_bytes)
    spark.createDataFrame([row], LOAD_LOG).write.mode("append").parquet(path)


def log_status(spark: SparkSession, dataset_id: str, status: str, path: str, at: dt.datetime, error: str | None = None) -> None:
    """IN-02: append one status event; an unknown status is an error."""
    if status not in inventory.STATUSES:
        raise ValueError(f"unknown status {status!r}; known are {', '.join(inventory.STATUSES)}")
    event = spark.createDataFrame([(dataset_id, status, at, error)], STATUS_LOG)
    inventory.status_events(event).write.mode("append").parquet(path)


def ingest_batch(
    spark: SparkSession, datasets: DataFrame, cells_of: Callable[[str], DataFrame], root: str,
    n: int = 5, threshold: int = 0, now: Callable[[], dt.datetime] = dt.datetime.now, **options,
) -> DataFrame:
    """IN-06 / IN-12: ingest the next pending datasets of an inventory, highest priority first.

    ``cells_of`` gives the cells of a dataset by id.  Every step is recorded in the
    status and load logs below ``root/logs``; a dataset that fails is marked so, with
    its message, and the others go on.  Returns the final status events of this
    batch with the type of each error.
    """
    chosen = inventory.next_batch(datasets, n, threshold).select("id", "domain").collect()
    status_log, load_log = f"{root.rstrip('/')}/logs/status", f"{root.rstrip('/')}/logs/loads"
    final = []
    for dataset in chosen:
        log_status(spark, dataset.id, "processing", status_log, now())
        try:
            report = ingest(spark, cells_of(dataset.id), dataset.domain, dataset.id, root, **options)
            log_load(spark, report, load_log, now())
            final.append((dataset.id, "completed", now(), None))
        except Exception as e:  # one dataset must not stop the others
            final.append((dataset.id, "failed", now(), f"{type(e).__name__}: {e}"))
        log_status(spark, *final[-1][:2], status_log, *final[-1][2:])
    outcome = spark.createDataFrame(final, STATUS_LOG)
    return outcome.withColumn(
        "error_type", F.when(F.col("status") == "failed", errors.error_type(F.col("error_message")))
    )
