"""Totals in two steps are those over all rows, to the bit, whatever the partitioning."""

import json

import pytest
from pyspark.sql import functions as F

from tests.conftest import values
from tidycell.operators import aggregates
from tidycell.plans import ingest
from tidycell.sources import files


def cells(spark, parts):
    figures = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 1e15, -1e15]
    rows = spark.range(21_000).select(
        F.lit("D").alias("dataset_id"), F.concat(F.lit("S"), F.col("id") % 3).alias("stats_data_id"), (2000 + F.col("id") % 2).cast("int").alias("year"),
        F.lit("1").alias("region_code"), F.element_at(F.array(*map(F.lit, figures)), (F.col("id") % len(figures) + 1).cast("int")).alias("value"))
    return rows.repartition(parts, F.rand(parts))


def test_totals_do_not_depend_on_partitions(spark):
    found = {parts: (aggregates.overview(cells(spark, parts)).first(), values(aggregates.dataset_profile(cells(spark, parts)))) for parts in (1, 4, 7)}
    assert found[1] == found[4] == found[7]
    assert found[1][0].total_value == aggregates.value_statistics(cells(spark, 5)).first().sum_value == pytest.approx(6533.2, abs=0.2)


def test_totals_of_values_that_no_decimal_holds(spark):
    rows = cells(spark, 3).withColumn("value", F.when(F.rand(1) < 0.1, 1e300).otherwise(F.col("value")))
    assert aggregates.overview(rows).first().total_value > 1e300
    none = aggregates.overview(rows.withColumn("value", F.lit(None).cast("double"))).first()
    assert (none.total_value, none.avg_value, none.record_count) == (None, None, 21_000)
    assert aggregates.overview(rows.limit(0)).first().record_count == 0


def test_unknown_status_is_an_error(spark, tmp_path):
    import datetime as dt

    with pytest.raises(ValueError):
        ingest.log_status(spark, "D", "waiting", str(tmp_path / "log"), dt.datetime(2024, 1, 1))


def test_row_groups_and_first_rows(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(50_000).selectExpr("id", "cast(id as string) as s", "id % 2 as k").repartitionByRange(2, "id").write.partitionBy("k") \
        .option("parquet.block.size", 64 << 10).option("compression", "gzip").parquet(path)
    found = files.row_groups(spark, path).collect()
    assert sum(r.rows for r in found) == 50_000 and len({r.file_path for r in found}) == 4 and max(r.row_group for r in found) > 0
    assert {(r.columns, r.codec) for r in found} == {(2, "gzip")} and all(0 < r.stored_bytes < r.bytes for r in found)
    heads = files.first_rows(spark, path, 3).collect()
    assert len(heads) == 12 and {r.position for r in heads} == {0, 1, 2}
    assert any(json.loads(r.row) == {"id": 0, "s": "0"} for r in heads if "k=0" in r.file_path)
    empty = str(tmp_path / "e")
    spark.range(0).write.parquet(empty)
    assert files.first_rows(spark, empty).count() == 0 and sum(r.rows for r in files.row_groups(spark, empty).collect()) == 0
