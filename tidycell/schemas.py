"""Fixed schemas: the wire cell, the eleven tidy domains, inventory and code lists.

One registry drives everything: for each domain it lists the dimension columns
between ``year`` and ``value`` together with the part of the wire cell they are
read from.  The table schema, the mapping projection and the partitioning all
derive from it, so they cannot drift apart.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

_TYPES = {
    "STRING": T.StringType(),
    "INT": T.IntegerType(),
    "BIGINT": T.LongType(),
    "DOUBLE": T.DoubleType(),
    "DATE": T.DateType(),
    "TIMESTAMP": T.TimestampType(),
}


@dataclass(frozen=True)
class Dimension:
    """A domain column and where it comes from.

    ``source`` is a wire field (``@area``, ``@cat01`` ...), ``quarter`` or
    ``month`` for the parts of ``@time``, or ``label:<category>`` for a label
    looked up in the code list.
    """

    name: str
    source: str
    type: str = "STRING"


_REGION = Dimension("region_code", "@area")
_QUARTER = Dimension("quarter", "quarter", "INT")
_MONTH = Dimension("month", "month", "INT")


def _cats(*names: str) -> tuple[Dimension, ...]:
    return tuple(Dimension(n, f"@cat{i:02d}") for i, n in enumerate(names, 1))


# The dimension columns of each domain, in table order.
DOMAINS: dict[str, tuple[Dimension, ...]] = {
    "population": (_REGION, Dimension("region_name", "label:area"), *_cats("category")),
    "economy": (_QUARTER, _REGION, *_cats("indicator")),
    "labor": (_MONTH, _REGION, *_cats("industry_code", "occupation_code", "indicator")),
    "education": (_REGION, *_cats("school_type", "category")),
    "health": (_REGION, *_cats("facility_type", "disease_code", "indicator")),
    "agriculture": (_REGION, *_cats("sector", "product_code", "indicator")),
    "construction": (_MONTH, _REGION, *_cats("building_type", "structure_type", "indicator")),
    "transport": (_MONTH, _REGION, *_cats("transport_mode", "indicator")),
    "trade": (_QUARTER, _REGION, *_cats("industry_code", "business_type", "indicator")),
    "social_welfare": (_REGION, *_cats("facility_type", "service_type", "indicator")),
    "generic": (_REGION, *_cats("category")),
}

_HEAD = (("dataset_id", "STRING"), ("stats_data_id", "STRING"), ("year", "INT"))
_TAIL = (("value", "DOUBLE"), ("unit", "STRING"), ("updated_at", "TIMESTAMP"))

# The dataset inventory and the code-list table.
INVENTORY_COLUMNS = (
    ("dataset_id", "STRING"),
    ("dataset_name", "STRING"),
    ("domain", "STRING"),
    ("organization", "STRING"),
    ("survey_date", "DATE"),
    ("open_date", "DATE"),
    ("total_records", "BIGINT"),
    ("ingestion_status", "STRING"),
    ("ingestion_timestamp", "TIMESTAMP"),
    ("table_name", "STRING"),
    ("s3_raw_location", "STRING"),
    ("s3_parquet_location", "STRING"),
    ("s3_iceberg_location", "STRING"),
    ("error_message", "STRING"),
    ("created_at", "TIMESTAMP"),
    ("updated_at", "TIMESTAMP"),
)
INVENTORY_REQUIRED = (
    "dataset_id", "dataset_name", "domain", "ingestion_status", "ingestion_timestamp", "table_name",
)
# The older seven-column load table and the economy table with long integers.
LOAD_TABLE_COLUMNS = (
    ("stats_data_id", "STRING"),
    ("year", "INT"),
    ("region_code", "STRING"),
    ("category", "STRING"),
    ("value", "DOUBLE"),
    ("unit", "STRING"),
    ("updated_at", "TIMESTAMP"),
)
LONG_ECONOMY_COLUMNS = (
    ("stats_data_id", "STRING"),
    ("year", "BIGINT"),
    ("quarter", "BIGINT"),
    ("region_code", "STRING"),
    ("indicator", "STRING"),
    ("value", "DOUBLE"),
    ("unit", "STRING"),
    ("updated_at", "TIMESTAMP"),
)
CODE_LIST_COLUMNS = (
    ("category_id", "STRING"),
    ("category_name", "STRING"),
    ("category_count", "INT"),
    ("code", "STRING"),
    ("name", "STRING"),
    ("level", "STRING"),
    ("parent_code", "STRING"),
    ("unit", "STRING"),
)


def resolve(domain: str) -> str:
    """PR-15: the domain itself when registered, otherwise ``generic``."""
    return domain if domain in DOMAINS else "generic"


def columns(domain: str) -> list[tuple[str, str]]:
    """(name, type) pairs of a domain table in table order."""
    dims = [(d.name, d.type) for d in DOMAINS[resolve(domain)]]
    return [*_HEAD, *dims, *_TAIL]


def column_names(domain: str) -> list[str]:
    return [name for name, _ in columns(domain)]


def dimension_names(domain: str) -> list[str]:
    """The columns that together identify one cell of a domain table."""
    return ["dataset_id", "stats_data_id", "year", *(d.name for d in DOMAINS[resolve(domain)]), "unit"]


def partition_columns(domain: str) -> list[str]:
    return ["year"] if resolve(domain) == "generic" else ["year", "region_code"]


def struct(pairs) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[t], True) for n, t in pairs])


def schema(domain: str) -> T.StructType:
    return struct(columns(domain))


def cell_schema(categories: int = 5) -> T.StructType:
    """The wire cell: nullable strings only. ``categories`` is the number of ``@catNN`` fields."""
    names = ["@id", "@tab", *(f"@cat{i:02d}" for i in range(1, categories + 1)), "@area", "@time", "@unit", "$"]
    return T.StructType([T.StructField(n, T.StringType(), True) for n in names])


INVENTORY = struct(INVENTORY_COLUMNS)
CODE_LIST = struct(CODE_LIST_COLUMNS)
