"""Plain file sources and sinks (SC-08, SC-09, SK-01 .. SK-05, SK-15)."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidycell import schemas

CODECS = ("snappy", "gzip", "zstd")
BOM = "﻿"

# Header of the exported code list.
CODE_LIST_HEADER = ("カテゴリID", "カテゴリ名", "カテゴリ数", "コード", "名称", "レベル", "親コード", "単位")


def text_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType(), True) for n in names])


def read_parquet(spark: SparkSession, paths) -> DataFrame:
    """SC-08: the named files only, never their whole directory."""
    return spark.read.parquet(*([paths] if isinstance(paths, str) else paths))


def parquet_profile(df: DataFrame) -> DataFrame:
    """SC-08: one row per column: position, type, and number of rows and non-null values."""
    names = df.columns
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *(F.count(f"`{n}`").alias(n) for n in names))
    rows = F.array(*(
        F.struct(
            F.lit(i).alias("position"), F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("type"), F.col(f"`{f.name}`").alias("non_null"),
        )
        for i, f in enumerate(df.schema)
    ))
    return one.select(F.explode(rows).alias("c"), F.col("_rows").alias("row_count")).select("c.*", "row_count")


ROW_GROUPS = "file_path string, row_group int, rows bigint, bytes bigint, stored_bytes bigint, columns int, codec string"
FIRST_ROWS = "file_path string, position int, row string"


def _parquet_files(spark: SparkSession, path: str, tasks: int | None) -> DataFrame:
    """The Parquet files at or below a path, a listing that opens none of them, dealt to tasks one by one."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where("path like '%.parquet'").select("path")
    return found.repartition(tasks or spark.sparkContext.defaultParallelism)


def _opened(uri: str):
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return pq.ParquetFile(store.open_input_file(path))


def row_groups(spark: SparkSession, path: str, tasks: int | None = None) -> DataFrame:
    """SC-08: one row per row group of every file: rows, bytes before and after compression, columns, codec.

    Tasks read the files' footers only.  The store must be one that pyarrow opens by its URI (local files, HDFS and the usual
    object stores).
    """
    def footers(batches):
        for batch in batches:
            rows = []
            for uri in batch.column(0).to_pylist():
                with _opened(uri) as f:
                    meta = f.metadata
                for i in range(meta.num_row_groups):
                    group = meta.row_group(i)
                    chunks = [group.column(k) for k in range(group.num_columns)]
                    codecs = sorted({c.compression.lower() for c in chunks})
                    rows.append((uri, i, group.num_rows, group.total_byte_size, sum(c.total_compressed_size for c in chunks), len(chunks), ",".join(codecs)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, _types(ROW_GROUPS))], names=[f.split()[0] for f in ROW_GROUPS.split(", ")])

    return _parquet_files(spark, path, tasks).mapInArrow(footers, ROW_GROUPS)


def first_rows(spark: SparkSession, path: str, n: int = 5, tasks: int | None = None) -> DataFrame:
    """SC-08: the first ``n`` rows of every file as JSON; of a file no more than the pages that hold them are decoded."""
    def heads(batches):
        for batch in batches:
            rows = []
            for uri in batch.column(0).to_pylist():
                with _opened(uri) as f:
                    head = next(f.iter_batches(batch_size=n), None)
                rows += [(uri, k, json.dumps(r, default=str, ensure_ascii=False)) for k, r in enumerate(head.to_pylist() if head is not None else [])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, _types(FIRST_ROWS))], names=[f.split()[0] for f in FIRST_ROWS.split(", ")])

    return _parquet_files(spark, path, tasks).mapInArrow(heads, FIRST_ROWS)


def _types(ddl: str) -> list[pa.DataType]:
    return [{"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[f.split()[1]] for f in ddl.split(", ")]


def read_csv(spark: SparkSession, path, names: list[str]) -> DataFrame:
    """SC-09: every column as text, so codes keep their leading zeros."""
    return (
        spark.read.schema(text_schema(names)).option("header", True).option("escape", '"')
        .option("multiLine", True).csv(path)
    )


def write_parquet(
    df: DataFrame, path: str, codec: str = "snappy", partition_by: list[str] | None = None,
    mode: str = "error", max_records: int = 0,
) -> None:
    """SK-01 / SK-02: compressed Parquet.

    For a partitioned write the rows are rebalanced by the partition columns:
    small partitions share a task and end up in one file each, while a partition
    that holds a large part of the rows is split over many tasks.
    """
    if codec not in CODECS:
        raise ValueError(f"codec must be one of {CODECS}")
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode(mode).option("compression", codec)
    if max_records:
        writer = writer.option("maxRecordsPerFile", max_records)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_csv(df: DataFrame, path: str, bom: bool = True, mode: str = "error") -> None:
    """SK-03: UTF-8 CSV with a header in every part; ``bom`` marks each part for spreadsheet programs."""
    if bom:
        df = df.toDF(BOM + df.columns[0], *df.columns[1:])
    (
        df.write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", "")
        .option("encoding", "UTF-8").csv(path)
    )


def write_code_list_csv(codes: DataFrame, path: str, bom: bool = True) -> None:
    """SK-04: the code list under its published header."""
    names = [n for n, _ in schemas.CODE_LIST_COLUMNS]
    write_csv(codes.select(*names).toDF(*CODE_LIST_HEADER), path, bom)


def write_cells(cells: DataFrame, path: str, dataset_id: str, chunk: str, mode: str = "error") -> None:
    """SK-05: raw cells as JSON lines under ``dataset_id=…/chunk=…``."""
    tagged = cells.withColumnsRenamed({chunk: "chunk"}).withColumn("dataset_id", F.lit(dataset_id))
    tagged.hint("rebalance", "chunk").write.mode(mode).partitionBy("dataset_id", "chunk").json(path)


def read_cells(spark: SparkSession, path: str, categories: int = 5) -> DataFrame:
    """The cells :func:`write_cells` wrote, with ``dataset_id`` as text and ``chunk`` as a number."""
    extra = T.StructType([T.StructField("dataset_id", T.StringType()), T.StructField("chunk", T.LongType())])
    return spark.read.schema(T.StructType(schemas.cell_schema(categories).fields + extra.fields)).json(path)


def file_inventory(df: DataFrame) -> DataFrame:
    """SK-15: path, size and row count of every file behind a file-based DataFrame; reads no data column."""
    files = df.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_size").alias("file_size"))
    return files.groupBy("file_path", "file_size").agg(F.count(F.lit(1)).alias("record_count"))
