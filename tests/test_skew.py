"""One key holding a third of all rows: whole results, and plans that do not gather it."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import values
from tidycell.operators import aggregates as A
from tidycell.operators import inventory as I
from tidycell.operators import joins as J
from tidycell.operators import labels
from tidycell.operators import quality as Q
from tidycell.operators import search as R

N = 30000


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one full key; the others are spread."""
    hot = F.col("id") % 3 == 0
    key = lambda cold: F.when(hot, F.lit(0)).otherwise(cold)
    return spark.range(N).select(
        "id", F.lit("D").alias("dataset_id"), key(F.col("id") % 50 + 1).cast("string").alias("stats_data_id"),
        (key(F.col("id") % 20) + 2000).cast("int").alias("year"), key(F.col("id") % 47 + 1).cast("string").alias("region_code"),
        F.lit("c").alias("category"), (F.col("id") % 1000).cast("double").alias("value"))


KEYS = ["dataset_id", "stats_data_id", "year", "region_code", "category"]


def test_first_per_key_is_cut_before_the_shuffle(skewed):
    df = Q.first_per_key(skewed, KEYS, ["id"])
    text = plan(df)
    assert "WindowGroupLimit" in text and text.index("Final") < text.index("Exchange") < text.index("Partial")
    assert df.count() == skewed.select(*KEYS).distinct().count()
    assert df.filter("region_code = '0'").first().id == 0


def test_latest_and_top_are_cut_before_the_shuffle(skewed):
    log = skewed.select(F.col("region_code").alias("k"), "id", F.lit("s").alias("status"))
    assert "Partial" in plan(I.latest(log, "k", [F.desc("id")]))
    scored = skewed.select(F.col("region_code").alias("query_id"), F.col("id").alias("position"), F.col("value").alias("score"))
    top = R.top_per_query(scored, 5, "score")
    assert "WindowGroupLimit" in plan(top)
    assert [r.position for r in top.filter("query_id = '0'").orderBy("rank").collect()] == [999, 3999, 6999, 9999, 12999]


def test_quarantine_counts_the_hot_key(skewed):
    good, bad = Q.quarantine(skewed, {}, KEYS)
    hot = bad.filter("region_code = '0'")
    assert hot.count() == N // 3 and good.count() + bad.count() == N


def test_distinct_counts_with_a_hot_dataset(skewed):
    got = {r.stats_data_id: (r.record_count, r.unique_years) for r in A.dataset_profile(skewed).collect()}
    assert got["0"] == (N // 3, 1) and sum(n for n, _ in got.values()) == N
    assert A.overview(skewed).first().record_count == N


def test_pairs_are_never_built(spark, skewed):
    # The hot key alone would make (N/3)^2 pairs.
    row = J.joined_statistics(skewed, skewed).filter("year = 2000").first()
    n = skewed.filter("year = 2000").groupBy("region_code").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s")).collect()
    assert row.region_count == len(n)
    assert row.left_total == pytest.approx(sum(r.n * r.s for r in n))
    assert row.right_avg == pytest.approx(sum(r.n * r.s for r in n) / sum(r.n * r.n for r in n))


def test_hot_code_gets_its_label(spark, skewed):
    codes = skewed.select(F.lit("area").alias("category_id"), F.col("region_code").alias("code"), F.concat(F.lit("r"), "region_code").alias("name")).distinct()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = labels.with_label(skewed, codes, "area", "region_code", "label")
        assert "BroadcastHashJoin" not in plan(df)
        assert df.filter("label = 'r0'").count() == N // 3 and df.count() == N
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_results_do_not_depend_on_partitioning(skewed):
    for report in (A.by_year_region, A.by_region, A.overview, A.dataset_profile, A.yearly_trend):
        assert values(report(skewed)) == values(report(skewed.repartition(13, "id")))
