"""Tables with a log: every load is a snapshot, commits are atomic, older states stay readable (SK-11, SK-12, SK-15, SK-16).

A table is a folder with

    data/load=<id>/<partitions>/*.parquet   the files a load wrote, never changed afterwards
    manifests/<id>/                         the files the load adds and removes, with rows and bytes
    log/<version>.json                      one small entry for each load that took effect

A load writes its files and its manifest first and takes effect by creating the next log entry, which fails if
another load was faster.  A load that dies before that leaves files that no reader sees (``leftovers``).  A load that
lost the race takes the next version if the others touched none of its partitions, and is judged again if they did.
So every cell is there once, whatever runs at once or dies, and a reader of one version sees one state.

Files hold what changes: a revision writes anew only the files with revised cells, a replacement
removes all files of the state before.  The store must refuse to rename a file onto an existing one in one step, as
HDFS does; for local files a hard link takes that place.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidycell import schemas
from tidycell.sources import files, tables

LOG = "version bigint, load string, operation string, committed_at timestamp, added_files bigint, removed_files bigint, added_rows bigint, removed_rows bigint, added_bytes bigint"
MANIFEST = "action string, file string, partition string, file_size bigint, record_count bigint"
APPEND, REVISE, REPLACE = "append", "revise", "replace"


class Conflict(RuntimeError):
    """Other loads were faster too often."""


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def latest(spark: SparkSession, path: str) -> int:
    """The newest version; 0 for a table without loads."""
    fs, log = _path(spark, f"{path.rstrip('/')}/log")
    if not fs.exists(log):
        return 0
    names = (f.getPath().getName() for f in fs.listStatus(log))
    return max((int(n[:-5]) for n in names if n[0] != "." and n.endswith(".json")), default=0)


def _publish(spark: SparkSession, path: str, version: int, entry: dict) -> bool:
    """Create a log entry in one step; False if the version is taken."""
    log = f"{path.rstrip('/')}/log"
    fs, draft = _path(spark, f"{log}/.{uuid.uuid4().hex}")
    target = _path(spark, f"{log}/{version:020d}.json")[1]
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps({"version": version, **entry}).encode()))
    out.close()
    try:
        if fs.getScheme() == "file":
            file = spark._jvm.java.io.File
            spark._jvm.java.nio.file.Files.createLink(file(target.toUri().getPath()).toPath(), file(draft.toUri().getPath()).toPath())
            return True
        return bool(fs.rename(draft, target))
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception):
            return False
        raise
    finally:
        fs.delete(draft, False)


def history(spark: SparkSession, path: str) -> DataFrame:
    """SK-15: one row per snapshot, with what it added and removed."""
    if not latest(spark, path):
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).json(f"{path.rstrip('/')}/log")


def _entries(spark: SparkSession, path: str, version: int | None) -> list:
    """The log entries that make up a version, oldest first: from the last replacement on."""
    found = history(spark, path)
    newest = latest(spark, path)
    if version is not None and not 0 <= version <= newest:
        raise ValueError(f"version {version} is not one of 0 to {newest}")
    rows = found.where(F.col("version") <= (newest if version is None else version)).orderBy("version").collect()
    last = max((k for k, r in enumerate(rows) if r.operation == REPLACE), default=0)
    return rows[last:]


def manifests(spark: SparkSession, path: str, loads: list[str] | None = None) -> DataFrame:
    """SK-15: the files that loads added and removed, ``(load, action, file, partition, file_size, record_count)``; all
    loads that took effect if none are named."""
    if loads is None:
        loads = [r.load for r in history(spark, path).select("load").collect()]
    if not loads:
        return spark.createDataFrame([], f"load string, {MANIFEST}")
    rows = spark.read.schema(MANIFEST).parquet(*(f"{path.rstrip('/')}/manifests/{x}" for x in loads))
    return rows.select(F.element_at(F.split("_metadata.file_path", "/"), -2).alias("load"), "*")


def live_files(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """SK-15: the files of a version, ``(load, file, partition, file_size, record_count)``."""
    entries = _entries(spark, path, version)
    listed = manifests(spark, path, [r.load for r in entries])
    if entries and entries[0].operation == REPLACE:  # what it removed was added before it
        listed = listed.where((F.col("load") != entries[0].load) | (F.col("action") == "add"))
    gone = listed.where("action = 'remove'").select("file")
    return listed.where("action = 'add'").drop("action").join(gone, "file", "left_anti")


def partition_summary(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """SK-15: files, rows and bytes of every partition of a version."""
    return live_files(spark, path, version).groupBy("partition").agg(
        F.count("*").alias("files"), F.sum("record_count").alias("record_count"), F.sum("file_size").alias("file_size"))


def leftovers(spark: SparkSession, path: str) -> list[str]:
    """Loads whose files are there but that never took effect: still running, or dead."""
    fs, data = _path(spark, f"{path.rstrip('/')}/data")
    if not fs.exists(data):
        return []
    there = {f.getPath().getName().removeprefix("load=") for f in fs.listStatus(data)}
    return sorted(there - {r.load for r in history(spark, path).select("load").collect()})


def _schema(domain: str, identity: bool) -> T.StructType:
    want = schemas.schema(domain)
    return T.StructType([*want.fields, T.StructField(tables.CELL_KEY, T.StringType())]) if identity else want


def _rows(spark: SparkSession, path: str, names: list[str], domain: str, identity: bool) -> DataFrame:
    want = _schema(domain, identity)
    if not names:
        return spark.createDataFrame([], want)
    data = f"{path.rstrip('/')}/data"
    # The list goes to Spark's index of files, which holds all files of any read.
    df = spark.read.schema(want).option("basePath", data).parquet(*(f"{data}/{n}" for n in names))
    return df.select(*(F.coalesce(n, F.lit("")).alias(n) if n == "region_code" else F.col(n) for n in want.names))


def read(spark: SparkSession, path: str, domain: str, version: int | None = None, identity: bool = False, span=None) -> DataFrame:
    """The table as of a version (the newest by default), in registry order and types; ``span`` keeps the partitions
    of those years, by name, before any file is looked at."""
    live = live_files(spark, path, version)
    if span is not None and span.a is not None:
        year = F.regexp_extract("partition", r"year=(\d+)", 1)
        live = live.where((year == "") | year.cast("int").between(span.a, span.b))
    return _rows(spark, path, [r.file for r in live.select("file").collect()], domain, identity)


def _relative(path: str) -> Column:
    """A file's name below the data folder, as it is in the store."""
    return F.regexp_extract(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))), r"/data/(load=[0-9a-f]{32}/.*)$", 1)


def _write(spark: SparkSession, rows: DataFrame, path: str, load: str, domain: str, removed: DataFrame | None) -> None:
    """A load's files and its manifest."""
    root, parts = path.rstrip("/"), schemas.partition_columns(domain)
    folder = f"{root}/data/load={load}"
    files.write_parquet(rows, folder, codec="zstd", partition_by=parts)
    new = spark.read.schema(rows.schema).option("basePath", f"{root}/data").parquet(folder)
    listed = new.select(_relative(path).alias("file"), F.col("_metadata.file_size").alias("file_size")).groupBy("file", "file_size").agg(F.count("*").alias("record_count"))
    listed = listed.select(F.lit("add").alias("action"), "file", F.regexp_extract("file", r"^[^/]*/(.*)/[^/]*$", 1).alias("partition"), "file_size", "record_count")
    if removed is not None:
        listed = listed.unionByName(removed.select(F.lit("remove").alias("action"), "file", "partition", "file_size", "record_count"))
    listed.write.parquet(f"{root}/manifests/{load}")


@dataclass(frozen=True)
class _Draft:
    """A load whose files are written."""

    load: str
    operation: str
    entry: dict


def _draft(spark: SparkSession, path: str, load: str, operation: str) -> _Draft:
    add, gone = F.col("action") == "add", F.col("action") == "remove"
    sums = manifests(spark, path, [load]).agg(
        F.count_if(add).alias("added_files"), F.count_if(gone).alias("removed_files"),
        *(F.coalesce(F.sum(F.when(c, F.col(v))), F.lit(0)).alias(n) for c, v, n in (
            (add, "record_count", "added_rows"), (gone, "record_count", "removed_rows"), (add, "file_size", "added_bytes")))).first().asDict()
    return _Draft(load, operation, {"load": load, "operation": operation, **sums})


def _commit(spark: SparkSession, path: str, draft: _Draft, base: int, at: dt.datetime | None, rebase: bool) -> int:
    """The version a load took, 0 if another one touched what it is based on."""
    stamp = (at or dt.datetime.now(dt.timezone.utc)).isoformat()
    for _ in range(1000):
        if _publish(spark, path, base + 1, {**draft.entry, "committed_at": stamp}):
            return base + 1
        newest = latest(spark, path)
        rows = history(spark, path).where(F.col("version").between(base + 1, newest)).collect()
        if not rebase or any(r.operation == REPLACE for r in rows):
            return 0
        own, others = manifests(spark, path, [draft.load]), manifests(spark, path, [r.load for r in rows])
        if not own.join(others, "partition", "left_semi").isEmpty():
            return 0
        base = newest
    raise Conflict(f"{path}: no version could be taken")


def load(
    spark: SparkSession, df: DataFrame, path: str, domain: str, keys: list[str] | None = None, at: dt.datetime | None = None, attempts: int = 20,
) -> tuple[tables.Load, int]:
    """SK-12: the idempotent load as one commit: what the table does not have is added, revised cells take the old ones'
    place, and conflicts are handed back, as in ``tables.load_new``; the version that holds it comes with the figures.

    Any number of loads may run at once.  ``df`` must give the same rows when it is computed again.
    """
    df = tables.check_schema(df, domain)
    own = keys is None
    keys = keys or tables.identity(df, domain)
    identity, kind = tables.CELL_KEY in df.columns, schemas.resolve(domain)
    span = tables.years(df)
    same = tables._same_cells(keys)
    for _ in range(attempts):
        base = latest(spark, path)
        present = read(spark, path, domain, base, identity, span) if base else None
        judged = tables.judge(spark, df, present, keys, f"load-{kind}")
        n = judged.counts
        conflicting = df.join(judged.keys_of("conflict").drop("_n"), same, "left_semi") if n["conflict"] else None
        done = tables.Load(n["new"], n["revised"], n["present"], n["copies"], n["conflicting"], conflicting)
        if not n["new"] and not n["revised"]:
            return done, base
        rows, removed = judged.rows(df, "new", "revised"), None
        if n["revised"]:
            revised = judged.keys_of("revised").drop("_n")
            held = present.withColumn("file", _relative(path)).join(revised, same, "left_semi").select("file").distinct()
            removed = tables.stage(spark, live_files(spark, path, base).join(held, "file", "left_semi"), f"removed-{kind}")
            names = [r.file for r in removed.select("file").collect()]
            rows = rows.unionByName(_rows(spark, path, names, domain, identity).join(revised, same, "left_anti"))
        name = uuid.uuid4().hex
        _write(spark, rows, path, name, domain, removed)
        draft = _draft(spark, path, name, REVISE if n["revised"] else APPEND)
        # Cells stay in their partition, so loads of other partitions do not matter; keys of one's own may not say the partition.
        version = _commit(spark, path, draft, base, at, rebase=own)
        if version:
            return tables.Load(done.loaded, done.revised, done.present, done.copies, done.conflicts, conflicting, draft.entry["added_bytes"]), version
    raise Conflict(f"{path}: other loads were faster {attempts} times")


def replace(spark: SparkSession, rows: DataFrame, path: str, domain: str, at: dt.datetime | None = None, attempts: int = 20) -> int:
    """SK-11 / SK-16: these rows take the place of the whole table in one commit; readers find the old
    state until then, and by its version ever after.  Returns the new version."""
    rows = tables.check_schema(rows, domain)
    for _ in range(attempts):
        base = latest(spark, path)
        removed = tables.stage(spark, live_files(spark, path, base), f"removed-{schemas.resolve(domain)}") if base else None
        name = uuid.uuid4().hex
        _write(spark, rows, path, name, domain, removed)
        version = _commit(spark, path, _draft(spark, path, name, REPLACE), base, at, rebase=False)
        if version:
            return version
    raise Conflict(f"{path}: other loads were faster {attempts} times")


def rebuild(spark: SparkSession, sources: list[str], path: str, domain: str) -> int:
    """SK-11 / SC-10: replace the table by the rows of the named files, all or nothing."""
    rows, expected = tables._checked_files(spark, sources, domain)
    version = replace(spark, rows, path, domain)
    written = history(spark, path).where(F.col("version") == version).first().added_rows
    if written != expected:
        raise RuntimeError(f"wrote {written} of {expected} rows")
    return version


def restore(spark: SparkSession, path: str, domain: str, version: int, at: dt.datetime | None = None) -> int:
    """Make an older state the newest one, as a commit of its own."""
    return replace(spark, read(spark, path, domain, version, identity=True), path, domain, at)
