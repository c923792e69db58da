"""Paged fetch of large datasets (SC-11 .. SC-16).

``paged_cells`` is a Python data source: each page of a dataset is one input
partition, so pages are fetched side by side, and a page that fails is retried
by Spark.  A task only moves the page's text; decoding happens
in the JVM with :mod:`tidycell.sources.wire`.

``land_pages`` fetches what a plan table (``chunk_plan``) asks for and is not landed yet.  The plan stays a
table: nothing about datasets or pages passes through the driver.
"""

from __future__ import annotations

import glob
import importlib
import os
import sys
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

CHUNK = 100_000


def landed_page(root: str, dataset_id: str, chunk_num: int, start: int, limit: int) -> str:
    """A page kept as JSON lines under ``dataset_id=…/chunk=…``, as a bare list."""
    lines: list[str] = []
    names = sorted(glob.glob(os.path.join(root, f"dataset_id={dataset_id}", f"chunk={chunk_num}", "part-*")))
    if not names:  # a planned page that is absent, or a store that is no local folder, is no empty page
        raise FileNotFoundError(f"no landed page {chunk_num} of {dataset_id} in {root}")
    for name in names:
        with open(name, encoding="utf-8") as part:
            lines.extend(line.strip() for line in part if line.strip())
    return "[" + ",".join(lines) + "]"


def url_page(root: str, dataset_id: str, chunk_num: int, start: int, limit: int) -> str:
    """A page behind a URL template with ``{dataset_id}``, ``{start}``, ``{limit}`` and ``{chunk}``."""
    url = root.format(dataset_id=dataset_id, start=start, limit=limit, chunk=chunk_num)
    with urllib.request.urlopen(url, timeout=60) as answer:
        return answer.read().decode("utf-8")


class PageRun(InputPartition):
    """Pages ``first`` .. ``last`` of one dataset."""

    def __init__(self, dataset_id: str, first: int, last: int, total: int):
        self.dataset_id, self.first, self.last, self.total = dataset_id, first, last, total


def _fetcher(name: str):
    if ":" not in name:
        return {"landed": landed_page, "url": url_page}[name]
    module, function = name.split(":")
    return getattr(importlib.import_module(module), function)


class PagedReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["root"]
        self.fetch = _fetcher(options.get("fetcher", "landed"))
        self.chunk = int(options.get("chunk", CHUNK))
        cap = int(options["max_records"]) if "max_records" in options else None
        self.pages_per_task = int(options.get("pages_per_task", 1))
        # "id:total,id:total": the sizes the catalogue states.
        pairs = [pair.rsplit(":", 1) for pair in options["datasets"].split(",") if pair]
        self.wanted = {dataset: int(total) if cap is None else min(int(total), cap) for dataset, total in pairs}
        self.only: dict[str, object] = {}

    def pushFilters(self, filters):
        """Equality on the dataset or the chunk drops pages before anything is fetched."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute in (("dataset_id",), ("chunk_num",)):
                name = f.attribute[0]
                if self.only.setdefault(name, f.value) == f.value:
                    continue
            yield f

    def partitions(self):
        """One page per task, or runs of ``pages_per_task``."""
        counts = {
            d: -(-n // self.chunk) for d, n in self.wanted.items() if n > 0 and self.only.get("dataset_id", d) == d
        }
        if "chunk_num" in self.only:
            k = self.only["chunk_num"]
            runs = [PageRun(d, k, k, self.wanted[d]) for d, n in counts.items() if 0 <= k < n]
        else:
            step = self.pages_per_task
            runs = [
                PageRun(d, i, min(i + step, n) - 1, self.wanted[d]) for d, n in counts.items() for i in range(0, n, step)
            ]
        return runs or [PageRun("", 0, -1, 0)]

    def read(self, run):
        for n in range(run.first, run.last + 1):
            start = n * self.chunk + 1
            limit = min(self.chunk, run.total - n * self.chunk)
            yield run.dataset_id, n, start, limit, self.fetch(self.root, run.dataset_id, n, start, limit)


class PagedCells(DataSource):
    @classmethod
    def name(cls):
        return "paged_cells"

    def schema(self):
        return "dataset_id string, chunk_num int, start_position bigint, page_limit int, value string"

    def reader(self, schema):
        return PagedReader(self.options)


def pages(spark: SparkSession, root: str, sizes: dict[str, int], fetcher: str = "landed", chunk: int = CHUNK,
          max_records: int | None = None, pages_per_task: int = 1) -> DataFrame:
    """SC-11: one row per page with its raw text; decode with :func:`tidycell.sources.wire.cells`.

    ``fetcher`` is ``landed``, ``url`` or ``module:function``.  All records are read unless
    ``max_records`` says otherwise; ``pages_per_task`` is the unit of retry.
    """
    # Workers get this module's code with the reader, wherever they start.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedCells)
    reader = spark.read.format("paged_cells") if max_records is None else spark.read.format("paged_cells").option("max_records", max_records)
    return (
        reader.option("root", root).option("fetcher", fetcher).option("chunk", chunk).option("pages_per_task", pages_per_task)
        .option("datasets", ",".join(f"{d}:{n}" for d, n in sizes.items())).load()
    )


def chunk_plan(datasets: DataFrame, chunk: int = CHUNK, max_records: int | None = None) -> DataFrame:
    """SC-12: ``(dataset_id, chunk_num, start_position, chunk_limit)`` for datasets with ``total_records``."""
    wanted = F.col("total_records") if max_records is None else F.least(F.col("total_records"), F.lit(max_records).cast("bigint"))
    numbers = F.sequence(F.lit(0).cast("bigint"), F.ceil(wanted / chunk) - 1)
    plan = datasets.filter("total_records > 0").select("dataset_id", wanted.alias("wanted"), F.explode(numbers).alias("chunk_num"))
    return plan.select(
        "dataset_id", "chunk_num", (F.col("chunk_num") * chunk + 1).alias("start_position"),
        F.least(F.lit(chunk).cast("bigint"), F.col("wanted") - F.col("chunk_num") * chunk).alias("chunk_limit"),
    )


def stored_page(root: str, dataset_id: str, chunk_num: int, start: int, limit: int) -> str:
    """``landed_page`` for any store that pyarrow opens by its URI (local files, HDFS and the usual object stores)."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(root)
    found = store.get_file_info(fs.FileSelector(f"{base}/dataset_id={dataset_id}/chunk={chunk_num}"))
    lines: list[str] = []
    for name in sorted(f.path for f in found if f.base_name.startswith("part-")):
        with store.open_input_stream(name) as part:
            lines += [line for line in part.read().decode("utf-8").splitlines() if line.strip()]
    return "[" + ",".join(lines) + "]"


FETCHED = "dataset_id string, chunk_num bigint, start_position bigint, page_limit bigint, value string, error string"


def fetch(plan: DataFrame, root: str, fetcher: Callable[[str, str, int, int, int], str] = stored_page, tasks: int | None = None) -> DataFrame:
    """SC-11: the pages of a plan, one row each; a page that cannot be had has an ``error`` and no value.

    Pages are dealt to ``tasks`` (as many as shuffle partitions by default), and a task holds one page at a time.
    """
    names = [f.split()[0] for f in FETCHED.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    got = (fetcher(root, *page), None)
                except Exception as e:  # recorded with the page, which the next run tries again
                    got = (None, f"{type(e).__name__}: {e}")
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*page, *got), types)], names=names)

    wanted = plan.select(F.col("dataset_id").cast("string"), *(F.col(c).cast("bigint") for c in ("chunk_num", "start_position", "chunk_limit")))
    dealt = wanted.repartition(*([tasks] if tasks else []), "dataset_id", "chunk_num")
    return dealt.mapInArrow(run, FETCHED)


def landed_pages(spark: SparkSession, path: str) -> DataFrame:
    """What ``land_pages`` wrote, failed attempts included."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], FETCHED)
    return spark.read.schema(FETCHED).parquet(path)


def land_pages(plan: DataFrame, path: str, root: str, fetcher: Callable[[str, str, int, int, int], str] = stored_page, tasks: int | None = None) -> DataFrame:
    """SC-11: fetch the pages of a plan that are not landed below ``path`` and append them there.

    A run again fetches only what is missing: pages that failed, or new ones of the plan.  Returns the pages of the plan that
    are missing still, with their last error (null if they were never tried).  Runs of one folder go one after another.
    """
    spark = plan.sparkSession
    keys = ["dataset_id", "chunk_num"]
    # Only keys and errors of the landed pages are read here, not their text.
    there = landed_pages(spark, path).where("error IS NULL").select(*keys)
    fetch(plan.join(there, keys, "left_anti"), root, fetcher, tasks).write.mode("append").parquet(path)
    landed = landed_pages(spark, path)
    errors = landed.where("error IS NOT NULL").groupBy(*keys).agg(F.max("error").alias("error"))
    return plan.join(landed.where("error IS NULL").select(*keys), keys, "left_anti").join(errors, keys, "left")


# The dimensions a fetch is split by, most preferred first.
SPLIT_ORDER = ("area", "time")


def split_plan(codes: DataFrame) -> DataFrame:
    """SC-13: one fetch per code of the dataset's area dimension, else time, else its first dimension.

    ``codes`` is the code list with ``dataset_id``.  The choice is made on one
    row per dataset and category and joined back, by a shuffle: choices grow with the datasets,
    and how many codes there are cannot be told from the documents' files when the join is planned.
    """
    rank = F.lit(len(SPLIT_ORDER))
    for i, name in reversed(list(enumerate(SPLIT_ORDER))):
        rank = F.when(F.col("category_id") == name, i).otherwise(rank)
    first = F.when(F.count_if(F.col("category_pos").isNull()) == 0, F.min("category_pos")).alias("category_pos")
    choice = codes.groupBy("dataset_id", "category_id").agg(first).groupBy("dataset_id").agg(
        F.min_by("category_id", F.struct(rank, "category_pos")).alias("category_id")
    )
    return codes.join(choice.hint("shuffle_merge"), ["dataset_id", "category_id"]).select(
        "dataset_id", F.col("category_id").alias("filter_category"), F.col("code").alias("filter_value"), "code_pos"
    )


def label_year(label: Column) -> Column:
    """SC-14: the year of a period label such as ``1960年`` or ``（概算）_2022年``."""
    return F.regexp_extract(label, "(?:^|_)([0-9]+)年(?:_|$)", 1)


TIME_WORDS = "年|時間|期間|時系列"


def period_plan(codes: DataFrame) -> DataFrame:
    """SC-14: for each dataset the periods of its time dimension, newest first (``fetch_order``).

    A dimension of more than ten codes counts as time when at least five of its
    first ten labels look like a year, or its name says so.
    """
    year = F.nullif(label_year(F.col("name")), F.lit("")).try_cast("int")
    marked = codes.withColumn("period_year", year)
    plausible = F.col("period_year").between(1900, 2030) & (F.col("code_pos") < 10)
    judged = marked.groupBy("dataset_id", "category_id", "category_pos").agg(
        F.count(F.lit(1)).alias("size"), F.count_if(plausible).alias("year_like"),
        F.max(F.col("category_name").rlike(TIME_WORDS)).alias("named"),
    ).filter("size > 10 AND (year_like >= 5 OR named)")
    chosen = judged.groupBy("dataset_id").agg(F.min_by("category_id", "category_pos").alias("category_id"))
    # By a shuffle, as in ``split_plan``.
    periods = marked.join(chosen.hint("shuffle_merge"), ["dataset_id", "category_id"]).filter("period_year IS NOT NULL")
    order = Window.partitionBy("dataset_id").orderBy(F.desc("period_year"), "code_pos")
    return periods.select(
        "dataset_id", "category_id", "period_year", F.col("name").alias("period_label"),
        F.row_number().over(order).alias("fetch_order"),
    )
