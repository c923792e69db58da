"""Managed loads into partitioned Parquet tables (SK-06 .. SK-17, SC-10).

A batch that several steps need is staged first: written once below the scratch
folder, with everything after reading that copy.  It is thus computed once,
stays the same if an executor is lost, and is never read from a path that is
being overwritten.
"""

from __future__ import annotations

from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidycell import schemas
from tidycell.session import scratch
from tidycell.sources import files

# Identity of a cell; kept in the files beside the columns of the table, which readers see without it.
CELL_KEY = "cell_key"


def location(root: str, domain: str) -> str:
    """SK-14: the folder of a domain table."""
    return f"{root.rstrip('/')}/iceberg-tables/{domain}/{domain}_data/"


def location_column(root: str, domain):
    """SK-14 for a column of domains."""
    return F.concat(F.lit(f"{root.rstrip('/')}/iceberg-tables/"), domain, F.lit("/"), domain, F.lit("_data/"))


def _ddl(pairs, comments: dict[str, str]) -> str:
    def one(name, type_):
        comment = comments.get(name)
        return f"`{name}` {type_}" + (f" COMMENT '{comment}'" if comment else "")

    return ", ".join(one(n, t) for n, t in pairs)


def create_domain_table(
    spark: SparkSession, name: str, domain: str, path: str, comments: dict[str, str] | None = None,
    properties: dict[str, str] | None = None,
) -> None:
    """SK-06 / SK-10: a partitioned Parquet table with the registry columns of ``domain``."""
    props = {"write_compression": "snappy", **(properties or {})}
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({_ddl(schemas.columns(domain), comments or {})}) USING parquet "
        f"PARTITIONED BY ({', '.join(schemas.partition_columns(domain))}) LOCATION '{path}' "
        f"TBLPROPERTIES ({', '.join(f'{k!r} = {v!r}' for k, v in props.items())})"
    )


def create_inventory_table(spark: SparkSession, name: str, path: str) -> None:
    """SK-07."""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({_ddl(schemas.INVENTORY_COLUMNS, {})}) USING parquet LOCATION '{path}'"
    )


def table_columns(spark: SparkSession, name: str) -> list[tuple[str, str, bool]]:
    """SK-08: ``(column, type, is partition column)`` of a catalogue table."""
    return [(c.name, c.dataType, c.isPartition) for c in spark.catalog.listColumns(name)]


def read_domain(spark: SparkSession, path, domain: str, identity: bool = False) -> DataFrame:
    """A domain table by path, in registry order and types.

    The schema is given, so ``region_code=01000`` stays text; an empty region
    is stored as the default partition and comes back as NULL, hence the coalesce.
    ``identity`` adds the cells' key, NULL in files that were written without it.
    """
    want = schemas.schema(domain)
    if identity:
        want = T.StructType([*want.fields, T.StructField(CELL_KEY, T.StringType())])
    df = spark.read.schema(want).parquet(path)
    return df.select(*(F.coalesce(n, F.lit("")).alias(n) if n == "region_code" else F.col(n) for n in want.names))


def read_existing(spark: SparkSession, path: str, domain: str, identity: bool = False) -> DataFrame | None:
    """The table at a path, or None when nothing was written there yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    try:
        return read_domain(spark, path, domain, identity)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def check_schema(df: DataFrame, domain: str) -> DataFrame:
    """Columns by name in registry order; a missing, extra or differently typed column is an error."""
    want = schemas.schema(domain)
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f.name for f in want if have.get(f.name) != f.dataType] + [n for n in have if n not in (*want.names, CELL_KEY)]
    if wrong:
        raise ValueError(f"columns do not match the {domain} table: {', '.join(wrong)}")
    return df.select(*want.names, *(n for n in have if n == CELL_KEY))


def conform(df: DataFrame, pairs, renamed: dict[str, str] | None = None) -> DataFrame:
    """SK-11: the columns of another table layout by name, widened or converted to its types.

    A value that does not fit its new type is an error, not a silent NULL.
    """
    df = df.withColumnsRenamed(renamed or {})
    missing = [n for n, _ in pairs if n not in df.columns]
    if missing:
        raise ValueError(f"no columns {', '.join(missing)}")
    return df.select(*(F.col(n).cast(f.dataType).alias(n) for (n, _), f in zip(pairs, schemas.struct(pairs))))


def stage(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write a batch below the scratch folder and read the copy."""
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(T.StructType(df.schema.fields)).parquet(path)


def append(spark: SparkSession, df: DataFrame, path: str, domain: str) -> None:
    """SK-09: append a batch by name after a schema check."""
    files.write_parquet(
        check_schema(df, domain), path, partition_by=schemas.partition_columns(domain), mode="append"
    )


@dataclass(frozen=True)
class Load:
    """What became of the rows of a load; the figures add up to the rows given."""

    loaded: int
    revised: int
    present: int
    copies: int
    conflicts: int
    #: Rows of cells that the batch itself gives several values; None if there are none.
    conflicting: DataFrame | None = None
    #: Bytes of the files this load wrote, revised partitions included.
    written_bytes: int = 0


def _same(left: list[str], right: list[str]):
    return [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)]


def _packed(key: str) -> Column:
    """A key column as verdicts keep and compare it: the digests in ``cell_key`` as bytes, which take half the room of
    their digits; another text there as its own bytes, so that no two differ in one form and agree in the other."""
    c = F.col(key)
    if key != CELL_KEY:
        return c
    digest = F.concat(F.unhex(F.lit("00")), F.unhex(c))
    return F.when(c.rlike("\\A[0-9a-f]{64}\\z"), digest).otherwise(F.concat(F.unhex(F.lit("01")), c.cast("binary")))


def _same_cells(keys: list[str]):
    """Rows beside the keys of verdicts (``Judged.keys_of``)."""
    return [_packed(k).eqNullSafe(F.col(f"_{k}")) for k in keys]


def _overwrite(df: DataFrame, path: str, domain: str) -> None:
    columns = schemas.partition_columns(domain)
    df.hint("rebalance", *columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(path)


def write_by(df: DataFrame, path: str, *columns: str) -> None:
    """FL-11: rows in a folder per value of the columns, for reads that select some of them; a value with many rows is
    written by many tasks."""
    df.hint("rebalance", *columns).write.mode("overwrite").partitionBy(*columns).parquet(path)


STATUSES = ("new", "present", "revised", "conflict")


@dataclass(frozen=True)
class Judged:
    """The cells of a batch against what a table has: ``(keys, _n, _status)``, keys packed, staged, with counts by status."""

    cells: DataFrame
    keys: list[str]
    counts: dict[str, int]

    def keys_of(self, *statuses: str) -> DataFrame:
        return self.cells.where(F.col("_status").isin(*statuses)).select(*(F.col(k).alias(f"_{k}") for k in self.keys), "_n")

    def rows(self, df: DataFrame, *statuses: str) -> DataFrame:
        """One row of the batch for each cell of these statuses; of equal copies the one with the least columns."""
        if not self.counts["copies"] and not any(n for s, n in self.counts.items() if s in STATUSES and s not in statuses):
            return df  # all of the batch
        names = [c for c in df.columns if c != "updated_at"]
        found = df.join(self.keys_of(*statuses), _same_cells(self.keys))
        one = found.where("_n = 1").select(*df.columns)
        if not self.counts["copied"]:
            return one
        copies = found.where("_n > 1").groupBy(*self.keys).agg(F.min(F.struct("updated_at", *names)).alias("_r"))
        return one.unionByName(copies.select("_r.*"))


def identity(df: DataFrame, domain: str) -> list[str]:
    """The columns that name a cell: dataset and ``cell_key``, or without that column the dimensions of the table."""
    return ["dataset_id", CELL_KEY] if CELL_KEY in df.columns else schemas.dimension_names(domain)


def judge(spark: SparkSession, df: DataFrame, present: DataFrame | None, keys: list[str], name: str) -> Judged:
    """Compare the cells of a batch with those of a table by key and value alone.

    Whole rows do not travel: each side is first reduced to counts and extremes by key in every task.
    A cell with several values in the batch is a conflict; else it is new, present or revised.
    The verdicts are written once, and their counts are observed by that write.
    """
    cells = df.groupBy(*(_packed(k).alias(k) for k in keys)).agg(F.count("*").alias("_n"), F.count("value").alias("_v"), F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    status = F.when((F.col("_v") != 0) & ((F.col("_v") != F.col("_n")) | (F.col("_lo") != F.col("_hi"))), "conflict")
    if present is None:
        cells = cells.select(*keys, "_n", status.otherwise("new").alias("_status"))
    else:
        known = [f"_{k}" for k in keys]
        there = present.select(*(_packed(k).alias(f"_{k}") for k in keys), F.col("value").alias("_value"))
        there = there.join(df.select(*(_packed(k).alias(k) for k in keys)), _same(keys, known), "left_semi").groupBy(*known).agg(
            F.count("*").alias("_rows"), F.count("_value").alias("_valued"), F.min("_value").alias("_least"), F.max("_value").alias("_most"))
        equal = F.when(F.col("_lo").isNull(), F.col("_valued") == 0).otherwise(
            (F.col("_valued") == F.col("_rows")) & (F.col("_least") == F.col("_lo")) & (F.col("_most") == F.col("_lo")))
        cells = cells.join(there, _same(keys, known), "left").select(
            *keys, "_n", status.when(F.col("_rows").isNull(), "new").when(equal, "present").otherwise("revised").alias("_status"))
    seen = Observation()
    of = {s: F.col("_status") == s for s in STATUSES}
    copies = F.when(of["conflict"], 0).otherwise(F.col("_n") - 1)
    counted = [F.count_if(c).alias(s) for s, c in of.items()]
    counted += [F.coalesce(F.sum(copies), F.lit(0)).alias("copies"), F.coalesce(F.sum(F.when(of["conflict"], F.col("_n"))), F.lit(0)).alias("conflicting")]
    counted += [F.count_if((F.col("_n") > 1) & (of["new"] | of["revised"])).alias("copied")]
    staged = stage(spark, cells.observe(seen, *counted), name)
    return Judged(staged, keys, seen.get)


def years(df: DataFrame):
    """The first and last year of a batch."""
    return df.agg(F.min("year").alias("a"), F.max("year").alias("b")).first()


def within(df: DataFrame, span) -> DataFrame:
    """Rows of the years a batch reaches over, which removes partitions from the scan."""
    return df if span.a is None else df.filter(F.col("year").between(span.a, span.b) | F.col("year").isNull())


def load_new(spark: SparkSession, df: DataFrame, path: str, domain: str, keys: list[str] | None = None) -> Load:
    """SK-12: load what the table does not have; running it again changes nothing.

    A cell is known by its dataset and ``cell_key`` (all dimensions as they came); a
    batch without that column by the dimension columns of the table.  Equal copies in the batch
    count once.  A cell with several values in one batch is a conflict: its rows are handed
    back and none is loaded.  A known cell with another value is a revision: the
    partitions with revisions are written anew with all their other rows, of this
    and other datasets.  All else is appended.

    Of the table only the years within the batch's range are read, and of those only keys and values of
    cells the batch also has.  The batch is judged once (see ``judge``), so the counts, the
    rewrite and the append agree.  Two loads of one plain table must not run at once; ``snapshots.load`` may.
    """
    df = check_schema(df, domain)
    keys = keys or identity(df, domain)
    present = read_existing(spark, path, domain, CELL_KEY in df.columns)
    if present is not None:
        span = years(df)
        present = within(present, span)
    kind = schemas.resolve(domain)
    judged = judge(spark, df, present, keys, f"load-{kind}")
    n = judged.counts
    if n["revised"]:
        parts = schemas.partition_columns(domain)
        revised = judged.rows(df, "revised")
        where = revised.select(*(F.col(p).alias(f"_{p}") for p in parts)).distinct()
        stay = present.join(where, _same(parts, [f"_{p}" for p in parts]), "left_semi").join(
            judged.keys_of("revised"), _same_cells(keys), "left_anti")
        _overwrite(stage(spark, stay.unionByName(revised), f"revise-{kind}"), path, domain)
    if n["new"] or present is None:
        append(spark, judged.rows(df, "new"), path, domain)
    size = written_since(spark, judged.cells, path, domain) if n["new"] or n["revised"] else 0
    conflicting = df.join(judged.keys_of("conflict").drop("_n"), _same_cells(keys), "left_semi") if n["conflict"] else None
    return Load(n["new"], n["revised"], n["present"], n["copies"], n["conflicting"], conflicting, size)


def written_since(spark: SparkSession, staged: DataFrame, path: str, domain: str) -> int:
    """Bytes of the table's files that are newer than a staged batch, which is written just before them.

    The condition on the files' times selects files before any is opened, so the size of
    the table does not matter; the staged files give the time, so no clock but the store's does.
    """
    since = staged.agg(F.max("_metadata.file_modification_time").alias("t")).first().t
    if since is None:
        return 0
    new = read_domain(spark, path, domain).where(F.col("_metadata.file_modification_time") >= F.lit(since))
    return files.file_inventory(new).agg(F.coalesce(F.sum("file_size"), F.lit(0)).cast("bigint").alias("n")).first().n


def replace_partitions(spark: SparkSession, df: DataFrame, path: str, domain: str) -> None:
    """SK-12: the other idempotent load: the batch takes the place of its datasets' rows in the partitions
    it holds; rows of other datasets there are written back."""
    rows = check_schema(df, domain)
    present = read_existing(spark, path, domain, CELL_KEY in rows.columns)
    if present is not None:
        parts = schemas.partition_columns(domain)
        where = rows.select(*(F.col(p).alias(f"_{p}") for p in parts)).distinct()
        own = rows.select(F.col("dataset_id").alias("_dataset_id")).distinct()
        others = present.join(where, _same(parts, [f"_{p}" for p in parts]), "left_semi").join(own, _same(["dataset_id"], ["_dataset_id"]), "left_anti")
        rows = rows.unionByName(others)
    _overwrite(stage(spark, rows, f"replace-{schemas.resolve(domain)}"), path, domain)


def _checked_files(spark: SparkSession, sources: list[str], domain: str) -> tuple[DataFrame, int]:
    """The rows of the named files as one read, and their number; a file with other columns is an error.

    The footers are compared by a Spark job, not one by one on the driver.  A file that lacks a
    column reads as NULL there, so a dimension without any value in a file counts as missing.
    """
    try:
        merged = spark.read.option("mergeSchema", True).parquet(*sources)
    except (PySparkException, Py4JError) as e:  # which of them depends on where Spark notices it
        if "CANNOT_MERGE" in str(e):
            raise ValueError(f"the files do not agree on the columns of the {domain} table") from e
        raise
    rows = check_schema(merged, domain)
    needed = [n for n in schemas.dimension_names(domain) if n not in ("unit", "region_code")]
    each = rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"), *(F.count(c).alias(c) for c in needed))
    lacks = F.concat_ws(", ", *(F.when(F.col(c) == 0, F.lit(c)) for c in needed))
    found = each.select("file", "n", lacks.alias("lacks")).agg(
        F.sum("n").alias("n"), F.min(F.when(F.col("lacks") != "", F.struct("file", "lacks"))).alias("bad")).first()
    if found.bad is not None:
        raise ValueError(f"{found.bad.file} has no {found.bad.lacks}")
    return rows, found.n or 0


def rebuild(spark: SparkSession, sources: list[str], path: str, domain: str, name: str) -> int:
    """SK-11 / SK-16 / SC-10: replace a table by the rows of the named files, all or nothing.

    Every file is checked against the registry first and the new table goes to a location of its own
    below ``path``, where it gets an entry of its own with all its partitions.  Only when its
    rows are counted does that entry take the name, so readers see the old rows until
    then and a failure leaves them in place.  The files of the old version stay for those who are reading them.
    """
    rows, expected = _checked_files(spark, sources, domain)
    version = scratch(spark, "v").rsplit("-", 1)[1]
    target = f"{path.rstrip('/')}/v-{version}"
    files.write_parquet(rows, target, partition_by=schemas.partition_columns(domain))
    written = read_domain(spark, target, domain).count()
    if expected != written:
        raise RuntimeError(f"staged {written} of {expected} rows; the table was left as it was")
    new, old = f"{name}_new_{version}", f"{name}_old_{version}"
    create_domain_table(spark, new, domain, target)
    spark.sql(f"ALTER TABLE {new} RECOVER PARTITIONS")
    replaced = spark.catalog.tableExists(name)
    if replaced:
        spark.sql(f"ALTER TABLE {name} RENAME TO {old}")
    try:
        spark.sql(f"ALTER TABLE {new} RENAME TO {name}")
    except Exception:
        if replaced:
            spark.sql(f"ALTER TABLE {old} RENAME TO {name}")
        raise
    if replaced:
        spark.sql(f"DROP TABLE {old}")
    return written


def add_columns(spark: SparkSession, name: str, columns: list[tuple[str, str]]) -> None:
    """SK-13: new columns; existing rows read as NULL in them."""
    spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({_ddl(columns, {})})")


def read_evolved(spark: SparkSession, path: str) -> DataFrame:
    """SK-13 by path: files of several schema generations as one table."""
    return spark.read.option("mergeSchema", True).parquet(path)


def save_metadata(documents: DataFrame, path: str, mode: str = "append") -> None:
    """SK-17: one metadata document per dataset, ``(dataset_id, metadata_json)``."""
    documents.select("dataset_id", "metadata_json").write.mode(mode).parquet(path)


def load_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("dataset_id string, metadata_json string").parquet(path)


def save_documents(documents: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """SK-17: metadata documents as typed values, ``(dataset_id, document)`` with a VARIANT; returns those that are no
    JSON, ``(dataset_id, metadata_json)``, which are set aside below ``path-rejected``.

    Documents are parsed once, by the tasks that hold them: a condition on the outcome of a parse would be moved to where
    the documents are read, and parse them there again for each of the two tables."""
    parsed = documents.select("dataset_id", "metadata_json", F.try_parse_json("metadata_json").alias("document"))
    parsed = stage(documents.sparkSession, parsed.withColumn("metadata_json", F.when(F.col("document").isNull(), F.col("metadata_json"))), "documents")
    parsed.where("document is not null").select("dataset_id", "document").write.mode(mode).parquet(path)
    rejected = f"{path.rstrip('/')}-rejected"
    parsed.where("document is null").select("dataset_id", "metadata_json").write.mode(mode).parquet(rejected)
    return load_metadata(documents.sparkSession, rejected)


def load_documents(spark: SparkSession, path: str, fields: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """SK-17: saved documents; ``fields`` names values to read out of them, ``{column: (path, type)}``, NULL where a
    document has none of that type."""
    docs = spark.read.schema("dataset_id string, document variant").parquet(path)
    if not fields:
        return docs
    return docs.select("dataset_id", *(F.try_variant_get("document", p, t).alias(c) for c, (p, t) in fields.items()))
