"""Continuous pickup of landed documents (ST-01, ST-02).

New files below the landing folder are read as they appear.  Each micro-batch
goes through the same steps as a batch ingest and ends in the idempotent load:
a replayed batch, a re-delivered chunk, or a combined file that repeats its
chunks finds its cells already there and adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidycell.operators import domains, quality
from tidycell.plans.ingest import default_rules
from tidycell.sources import tables, wire


def documents(spark: SparkSession, path: str, whole: bool = True, files_per_batch: int | None = None) -> DataFrame:
    """ST-01: a stream of landed documents, one per file or per line."""
    reader = spark.readStream.format("text").option("wholetext", whole).option("recursiveFileLookup", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def load_batch(batch: DataFrame, batch_id: int, domain: str, dataset_id: str | None, table: str,
               bad: str | None = None, updated_at=None, on_bad: str = "null",
               codes: DataFrame | None = None, rejects: str | None = None, ledger: str | None = None) -> bool:
    """One micro-batch: decode, map with the labels of ``codes``, set bad rows aside, load what is new.

    ``rejects`` is where documents that could not be read go, with a reason, a folder per batch.  With a ``ledger`` a
    batch whose number is noted there is skipped; False says so.
    """
    spark = batch.sparkSession
    if ledger and loaded(spark, ledger, batch_id):
        return False
    if rejects:
        wire.rejected_documents(batch).write.mode("overwrite").parquet(f"{rejects.rstrip('/')}/batch={batch_id}")
    cells = wire.cells(wire.accepted_documents(batch))
    mapped = domains.to_domain(
        domains.with_identity(cells), domain, dataset_id, codes, on_bad=on_bad, updated_at=updated_at, keep=(tables.CELL_KEY,))
    reasoned = tables.stage(spark, quality.with_reasons(mapped, default_rules()), "micro-batch")
    good = reasoned.filter(F.size("reasons") == 0).drop("reasons")
    load = tables.load_new(spark, good, table, domain)
    if bad:
        # A replayed batch overwrites its own folder instead of adding to it.
        rejected = reasoned.filter(F.size("reasons") > 0)
        if load.conflicting is not None:
            rejected = rejected.unionByName(load.conflicting.withColumn("reasons", F.array(F.lit("conflicting_value"))))
        rejected.write.mode("overwrite").parquet(f"{bad.rstrip('/')}/batch={batch_id}")
    if ledger:
        store, note = _note(spark, ledger, batch_id)
        store.create(note, True).close()
    return True


def _note(spark: SparkSession, ledger: str, batch_id: int):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{ledger.rstrip('/')}/batch={batch_id}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def loaded(spark: SparkSession, ledger: str, batch_id: int) -> bool:
    """ST-02: whether a batch was loaded to its end."""
    store, note = _note(spark, ledger, batch_id)
    return store.exists(note)


def run(stream: DataFrame, checkpoint: str, domain: str, dataset_id: str | None, table: str, bad: str | None = None,
        updated_at=None, on_bad: str = "null", codes: DataFrame | None = None, rejects: str | None = None):
    """Start the pickup for everything available now; returns the query."""
    def each(batch, batch_id):
        load_batch(batch, batch_id, domain, dataset_id, table, bad, updated_at, on_bad, codes, rejects, f"{checkpoint.rstrip('/')}/loaded")

    return (
        stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
