"""Expressions over table metadata documents (PR-17 .. PR-19, SC-15)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds of the fetch mode and of the filtering advice.
SINGLE_REQUEST_LIMIT = 100_000

# Flattened field -> JSON paths tried in order inside TABLE_INF.
_SPEC = "$.STATISTICS_NAME_SPEC"
TABLE_INFO_FIELDS = {
    "statsCode": ("$.STAT_NAME['@code']",),
    "limit": (),
    "updatedDate": ("$.UPDATED_DATE",),
    "SURVEY_YEARS": ("$.SURVEY_DATE",),
    "OPEN_YEARS": ("$.OPEN_DATE",),
    "MAIN_CATEGORY": ("$.MAIN_CATEGORY['$']", "$.MAIN_CATEGORY"),
    "SUB_CATEGORY": ("$.SUB_CATEGORY['$']", "$.SUB_CATEGORY"),
    "OVERALL_TOTAL_NUMBER": ("$.OVERALL_TOTAL_NUMBER",),
    "UPDATED_DATE": ("$.UPDATED_DATE",),
    "STATISTICS_NAME_SPEC": (_SPEC,),
    "TABULATION_CATEGORY": (f"{_SPEC}.TABULATION_CATEGORY",),
    "TABULATION_SUB_CATEGORY1": (f"{_SPEC}.TABULATION_SUB_CATEGORY1",),
    "TABULATION_SUB_CATEGORY2": (f"{_SPEC}.TABULATION_SUB_CATEGORY2",),
    "TABULATION_SUB_CATEGORY3": (f"{_SPEC}.TABULATION_SUB_CATEGORY3",),
    "TABULATION_SUB_CATEGORY4": (f"{_SPEC}.TABULATION_SUB_CATEGORY4",),
    "TABULATION_SUB_CATEGORY5": (f"{_SPEC}.TABULATION_SUB_CATEGORY5",),
    "datasetId": ("$['@id']",),
    "STAT_NAME": ("$.STAT_NAME['$']",),
    "GOV_ORG": ("$.GOV_ORG['$']",),
    "STATISTICS_NAME": ("$.STATISTICS_NAME",),
    "TITLE": ("$.TITLE['$']",),
    "CYCLE": ("$.CYCLE",),
    "COLLECT_AREA": ("$.COLLECT_AREA",),
    "DESCRIPTION": ("$.DESCRIPTION",),
}
# Fixed value: an absent STATISTICS_NAME_SPEC is an empty object, every other absent field is N/A.
_ABSENT = {"STATISTICS_NAME_SPEC": "{}"}


def table_info(raw) -> list[Column]:
    """PR-17: the flat fields of one TABLE_INF document, ``N/A`` where absent."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    return [
        F.coalesce(*(F.get_json_object(raw, p) for p in paths), F.lit(_ABSENT.get(name, "N/A"))).alias(name)
        for name, paths in TABLE_INFO_FIELDS.items()
    ]


def record_total(stated: Column, sizes: Column) -> Column:
    """PR-18: the stated total, else the product of the category sizes; NULL when neither is positive."""
    product = F.aggregate(sizes, F.lit(1).cast("bigint"), lambda acc, x: acc * x)
    product = F.when(F.size(sizes) > 0, product)
    return F.coalesce(F.nullif(stated, F.lit(0)), F.nullif(product, F.lit(0)))


def requires_filtering(total: Column) -> Column:
    """PR-19: whether a dataset is too large for one request; NULL when its size is unknown."""
    return F.when(total > 0, total >= SINGLE_REQUEST_LIMIT)


def fetch_mode(total: Column) -> Column:
    """SC-15: ``single`` up to the request limit, ``chunked`` above."""
    return F.when(F.coalesce(total, F.lit(0)) <= SINGLE_REQUEST_LIMIT, "single").otherwise("chunked")


def fetch_records(total: Column) -> Column:
    """SC-15: the records a fetch will ask for: all of them."""
    return total
