import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.conftest import values
from tidycell import schemas
from tidycell.operators import domains, labels
from tidycell.schemas import cell_schema

NOW = dt.datetime(2024, 5, 1, 12, 0)
CELL = ("0003", "1", "A", "B", "C", None, None, "13000", "2020Q2", "人", "1,234.5")


@pytest.fixture()
def cell(spark):
    return spark.createDataFrame([CELL], cell_schema())


EXPECTED = {
    "population": dict(region_code="13000", region_name="", category="A"),
    "economy": dict(quarter=2, region_code="13000", indicator="A"),
    "labor": dict(month=0, region_code="13000", industry_code="A", occupation_code="B", indicator="C"),
    "education": dict(region_code="13000", school_type="A", category="B"),
    "health": dict(region_code="13000", facility_type="A", disease_code="B", indicator="C"),
    "agriculture": dict(region_code="13000", sector="A", product_code="B", indicator="C"),
    "construction": dict(month=0, region_code="13000", building_type="A", structure_type="B", indicator="C"),
    "transport": dict(month=0, region_code="13000", transport_mode="A", indicator="B"),
    "trade": dict(quarter=2, region_code="13000", industry_code="A", business_type="B", indicator="C"),
    "social_welfare": dict(region_code="13000", facility_type="A", service_type="B", indicator="C"),
    "generic": dict(region_code="13000", category="A"),
}


@pytest.mark.parametrize("domain", list(EXPECTED))
def test_mapping(cell, domain):
    df = domains.to_domain(cell, domain, "DS", updated_at=NOW)
    got = df.first().asDict()
    common = dict(dataset_id="DS", stats_data_id="0003", year=2020, value=1234.5, unit="人", updated_at=NOW)
    assert got == {**common, **EXPECTED[domain]}
    assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in schemas.schema(domain)]


def test_column_counts():
    want = dict(population=9, economy=9, labor=11, education=9, health=10, agriculture=10, construction=11, transport=10, trade=11, social_welfare=10, generic=8)
    assert {d: len(schemas.columns(d)) for d in schemas.DOMAINS} == want
    for d in schemas.DOMAINS:
        assert set(schemas.partition_columns(d)) <= set(schemas.column_names(d))


def test_unknown_domain_is_generic(cell):
    assert domains.to_domain(cell, "weather").columns == schemas.column_names("generic")


def test_defaults(spark):
    empty = spark.createDataFrame([tuple([None] * 11)], cell_schema())
    row = domains.to_domain(empty, "labor", updated_at=NOW).first()
    assert (row.dataset_id, row.stats_data_id, row.year, row.month, row.region_code, row.value, row.unit) == ("", "", 2020, 0, "", 0.0, "")


def test_missing_wire_columns(rows):
    thin = rows("`@time` string, `$` string", ("2021", "7"))
    row = domains.to_domain(thin, "health", "H", updated_at=NOW).first()
    assert (row.year, row.region_code, row.disease_code, row.value) == (2021, "", "", 7.0)


def test_population_labels(cell, rows):
    codes = rows("category_id string, code string, name string, code_pos int", ("area", "13000", "Tokyo", 0), ("cat01", "13000", "wrong", 1))
    assert domains.to_domain(cell, "population", codes=codes, updated_at=NOW).first().region_name == "Tokyo"


def test_labels_unknown_and_duplicate(rows):
    codes = rows("category_id string, code string, name string, code_pos int", ("area", "1", "first", 0), ("area", "1", "second", 1))
    df = labels.with_label(rows("area string", ("1",), ("2",), (None,)), codes, "area", "area", "label")
    assert values(df) == [("1", "second"), ("2", ""), (None, "")]


def test_labels_of_several_columns(cell, rows):
    codes = rows("category_id string, code string, name string", ("cat01", "A", "Alpha"), ("area", "13000", "Tokyo"))
    row = labels.with_labels(cell, codes, {"@cat01": "cat01", "@area": "area", "@cat02": "cat02"}).first()
    assert (row["@cat01"], row.cat01_name, row.area_name, row.cat02_name) == ("A", "Alpha", "Tokyo", "")


def test_legacy(cell):
    old = cell.withColumns({"@time": F.lit("1991000000"), "$": F.lit("-")})
    row = domains.to_legacy(old, "population", "OLD", NOW).first()
    assert (row.year, row.value, row.region_code, row.category, row.region_name) == (1991000000, None, "A", "B", "")
    eco = domains.to_legacy(cell, "economy", "OLD", NOW).first()
    assert (eco.quarter, eco.year, eco.indicator) == (1, None, "A")
    assert domains.to_legacy(cell, "anything", "OLD", NOW).first().category == "A"


def test_infer_domain(rows):
    titles = rows("t string", ("人口推計",), ("労働力調査と人口",), ("gdp統計 GDP",), ("GDP 統計",), ("学校",), ("",), (None,), ("気象",), ("福祉と経済",))
    got = [r[0] for r in titles.select(domains.infer_domain(F.col("t"))).collect()]
    assert got == ["population", "population", "economy", "economy", "education", "generic", "generic", "generic", "social_welfare"]


def test_infer_domain_with_own_rules(rows):
    df = rows("t string", ("a.b",), ("axb",))
    assert [r[0] for r in df.select(domains.infer_domain(F.col("t"), [("dot", ("a.b",))], "none")).collect()] == ["dot", "none"]


def test_renamed_and_lineage(cell):
    assert {"category", "subcategory", "detail", "region_code", "year"} <= set(domains.renamed(cell).columns)
    row = domains.with_lineage(cell, "3.0", "getStatsData", NOW).first()
    assert (row.ingestion_timestamp, row.source_api_version, row.endpoint) == (NOW, "3.0", "getStatsData")


def test_hierarchy(rows):
    codes = rows("category_id string, code string, name string, level string, parent_code string", ("a", "0", "all", "1", ""), ("a", "1", "x", "2", "0"), ("a", "2", "y", "2", "0"), ("b", "0", "other", "1", ""))
    assert values(labels.with_parent(codes), "category_id", "code", "parent_name") == [("a", "0", None), ("a", "1", "all"), ("a", "2", "all"), ("b", "0", None)]
    assert values(labels.children_per_parent(codes), "category_id", "code", "children") == [("a", "0", 2), ("a", "1", 0), ("a", "2", 0), ("b", "0", 0)]
