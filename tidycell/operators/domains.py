"""Wire cells -> tidy domain rows (DM-01 .. DM-12, PR-08 .. PR-11, PR-14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidycell import schemas
from tidycell.functions import scalars as S
from tidycell.operators import labels

# Title terms of each domain in the order they are tried.
DOMAIN_TERMS = (
    ("population", ("人口", "世帯", "出生", "死亡", "国勢調査", "人口動態")),
    ("labor", ("労働", "雇用", "賃金", "給与", "就業", "失業", "労働力")),
    ("education", ("教育", "学校", "学生", "生徒", "児童", "教員", "大学")),
    ("health", ("保健", "医療", "患者", "病院", "診療所", "疾病", "健康")),
    ("agriculture", ("農業", "林業", "漁業", "農林", "水産", "農家", "漁獲")),
    ("construction", ("建設", "建築", "住宅", "着工", "土地", "不動産")),
    ("transport", ("運輸", "輸送", "交通", "通信", "自動車", "鉄道", "航空")),
    ("trade", ("商業", "小売", "卸売", "サービス", "飲食", "宿泊")),
    ("social_welfare", ("福祉", "介護", "保育", "年金", "社会保障", "生活保護")),
    ("economy", ("経済", "gdp", "産業", "企業", "事業所", "家計", "消費", "景気")),
)

# Plain renaming of wire dimensions.
RENAMED = {"@cat01": "category", "@cat02": "subcategory", "@cat03": "detail", "@area": "region_code", "@time": "year"}


def infer_domain(title: Column, rules=DOMAIN_TERMS, otherwise: str = "generic") -> Column:
    """PR-14: the first domain one of whose terms occurs in the lower-cased title."""
    return S.first_match(F.lower(F.coalesce(title, F.lit(""))), rules, otherwise)


def _text(cells: DataFrame, field: str) -> Column:
    return F.coalesce(F.col(f"`{field}`"), F.lit("")) if field in cells.columns else F.lit("")


def _stamp(updated_at) -> Column:
    return F.current_timestamp() if updated_at is None else F.lit(updated_at).cast("timestamp")


def with_identity(cells: DataFrame) -> DataFrame:
    """Cells with ``cell_key``: a digest of every dimension as it came, also of those that the table of a
    domain leaves out or shortens.  Two cells are the same if all their dimensions are."""
    dims = sorted(c for c in cells.columns if c.startswith("@"))
    parts = [F.concat(F.lit(f"{d}="), F.to_json(F.struct(F.coalesce(F.col(f"`{d}`"), F.lit("")).alias("v")))) for d in dims]
    return cells.withColumn("cell_key", F.sha2(F.concat_ws("|", *parts), 256))


def to_domain(
    cells: DataFrame,
    domain: str,
    dataset_id: str | None = None,
    codes: DataFrame | None = None,
    on_bad: str = "zero",
    default_year: int | None = S.DEFAULT_YEAR,
    updated_at=None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """DM-01 .. DM-11: map cells to the table of ``domain`` (unknown domains map to generic).

    One projection built from the registry.  ``codes`` is the code list that
    supplies labels; without it label columns are empty.  ``keep`` carries
    extra columns after the registry ones.
    """
    time = _text(cells, "@time")
    cell_id = _text(cells, "@id")
    parts = {"quarter": lambda: S.quarter(time), "month": lambda: S.month(time)}
    label_sources = {}
    for dim in schemas.DOMAINS[schemas.resolve(domain)]:
        if dim.source.startswith("label:") and codes is not None:
            category = dim.source.split(":", 1)[1]
            label_sources[dim.name] = f"_label_{category}"
            cells = labels.with_label(cells, codes, category, f"@{category}", f"_label_{category}")

    def source(dim):
        if dim.source in parts:
            return parts[dim.source]()
        if dim.source.startswith("label:"):
            return F.col(label_sources[dim.name]) if dim.name in label_sources else F.lit("")
        return _text(cells, dim.source)

    value = F.col("`$`") if "$" in cells.columns else F.lit(None).cast("string")
    return cells.select(
        (F.lit(dataset_id) if dataset_id else cell_id).alias("dataset_id"),
        cell_id.alias("stats_data_id"),
        S.year(time, default_year).alias("year"),
        *(source(d).alias(d.name) for d in schemas.DOMAINS[schemas.resolve(domain)]),
        S.measure(value, on_bad, separators=True).alias("value"),
        _text(cells, "@unit").alias("unit"),
        _stamp(updated_at).alias("updated_at"),
        *keep,
    )


# The dimension columns of the legacy mapping and their wire fields.
LEGACY = {
    "population": {"region_code": "@cat01", "region_name": None, "category": "@cat02"},
    "economy": {"quarter": 1, "region_code": "@area", "indicator": "@cat01"},
    "education": {"region_code": "@area", "school_type": "@cat01", "metric": "@cat02"},
    "generic": {"region_code": "@area", "category": "@cat01"},
}


def to_legacy(cells: DataFrame, domain: str, dataset_id: str, updated_at=None) -> DataFrame:
    """DM-12: the older mapping: null-preserving measures, the whole time code as year."""
    dims = LEGACY.get(domain, LEGACY["generic"])

    def source(field):
        if field is None:
            return F.lit("")
        return F.lit(field) if isinstance(field, int) else _text(cells, field)

    return cells.select(
        F.lit(dataset_id).alias("stats_data_id"),
        S.measure(F.col("`$`"), "null").alias("value"),
        _text(cells, "@unit").alias("unit"),
        S.legacy_year(F.col("`@time`")).alias("year"),
        *(source(field).alias(name) for name, field in dims.items()),
        _stamp(updated_at).alias("updated_at"),
    )


def renamed(cells: DataFrame) -> DataFrame:
    """PR-09: wire dimension names to readable ones."""
    return cells.withColumnsRenamed(RENAMED)


def with_lineage(df: DataFrame, api_version: str, endpoint: str, ingested_at=None) -> DataFrame:
    """PR-11: ingestion time, source API version and endpoint of every row."""
    return df.withColumns({
        "ingestion_timestamp": _stamp(ingested_at),
        "source_api_version": F.lit(api_version),
        "endpoint": F.lit(endpoint),
    })
