"""JSON documents of the statistics API as tables (SC-01 .. SC-07, SC-16, PR-17).

A document column goes through one ``from_json`` that picks out the status and
the raw text of the rows, then through one more that decodes the rows.  The
rows member may be a list, a single object (a list of one collapses to it) or
a list with stray non-objects; all three give the same cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidycell.functions import metadata as M
from tidycell.functions import scalars as S
from tidycell.schemas import cell_schema

_DATA_ENVELOPE = (
    "GET_STATS_DATA struct<RESULT: struct<STATUS: string, ERROR_MSG: string>,"
    " STATISTICAL_DATA: struct<RESULT_INF: struct<TOTAL_NUMBER: string>, DATA_INF: struct<VALUE: string>>>"
)
_META_ENVELOPE = (
    "GET_META_INFO struct<METADATA_INF: struct<TABLE_INF: string, CLASS_INF: struct<CLASS_OBJ: string>>>"
)
_LIST_ENVELOPE = "GET_STATS_LIST struct<DATALIST_INF: struct<TABLE_INF: string>>"
_CLASS_OBJ = "array<struct<`@id`: string, `@name`: string, CLASS: string>>"
_CLASS = (
    "array<struct<`@code`: string, `@name`: string, `@level`: string, `@parentCode`: string, `@unit`: string>>"
)
_TABLE = (
    "array<struct<`@id`: string, STAT_NAME: string, GOV_ORG: string, STATISTICS_NAME: string, TITLE: string,"
    " TITLE_SPEC: string, MAIN_CATEGORY: string, SUB_CATEGORY: string, DESCRIPTION: string,"
    " SURVEY_DATE: string, OPEN_DATE: string, UPDATED_DATE: string>>"
)


def as_list(raw: Column) -> Column:
    """SC-05: JSON text of a list; a lone object is wrapped, absent or scalar content is NULL."""
    text = S.json_text(raw)
    return F.when(text.startswith("["), text).when(text.startswith("{"), F.concat(F.lit("["), text, F.lit("]")))


def read_documents(spark: SparkSession, path, whole: bool = True) -> DataFrame:
    """Document files as ``(path, value)``: one document per file, or per line when ``whole`` is False."""
    df = spark.read.text(path, wholetext=whole)
    return df.select(F.col("_metadata.file_path").alias("path"), "value")


def envelope(df: DataFrame, text: str = "value") -> DataFrame:
    """SC-01 / SC-02 / SC-16: add ``form, status, error_message, total_number, rows_json`` to documents."""
    content = S.json_text(text)
    is_list = content.startswith("[")
    df = df.withColumn("_doc", F.when(~is_list, F.from_json(content, _DATA_ENVELOPE)))
    body = F.col("_doc.GET_STATS_DATA")
    return df.select(
        *[c for c in df.columns if c != "_doc"],
        F.when(is_list, "list").when(body.isNotNull(), "envelope").otherwise("unreadable").alias("form"),
        body["RESULT"]["STATUS"].try_cast("int").alias("status"),
        body["RESULT"]["ERROR_MSG"].alias("error_message"),
        body["STATISTICAL_DATA"].isNotNull().alias("has_data"),
        body["STATISTICAL_DATA"]["RESULT_INF"]["TOTAL_NUMBER"].try_cast("bigint").alias("total_number"),
        as_list(
            F.when(is_list, F.col(text)).otherwise(body["STATISTICAL_DATA"]["DATA_INF"]["VALUE"])
        ).alias("rows_json"),
    )


def rejected(check_rows: bool = True) -> Column:
    """SC-16: a document that reports an error, carries no data, or is damaged, over :func:`envelope` columns.

    ``check_rows`` also decodes the rows, so a truncated list is reported instead
    of passing as an empty one.
    """
    bad_status = F.coalesce(F.col("status"), F.lit(0)) != 0
    bad = (F.col("form") == "unreadable") | ((F.col("form") == "envelope") & (bad_status | ~F.col("has_data")))
    if check_rows:
        undecodable = F.from_json("rows_json", "array<string>").isNull()
        bad = bad | (F.col("rows_json").isNotNull() & undecodable)
    return bad


def rejected_documents(df: DataFrame, text: str = "value") -> DataFrame:
    """SC-16: the documents that :func:`rejected` names, damaged row lists included, each with a reason."""
    bad = envelope(df, text).filter(rejected())
    reason = (
        F.when(F.col("form") == "unreadable", "unreadable")
        .when((F.col("form") == "envelope") & (F.coalesce("status", F.lit(0)) != 0), F.concat_ws(": ", F.concat(F.lit("status "), "status"), "error_message"))
        .when((F.col("form") == "envelope") & ~F.col("has_data"), "no data")
        .otherwise("damaged rows")
    )
    return bad.select(*df.columns, reason.alias("reason"))


def accepted_documents(df: DataFrame, text: str = "value") -> DataFrame:
    """SC-16: the other documents."""
    return envelope(df, text).filter(~F.coalesce(rejected(), F.lit(False))).select(*df.columns)


def last_page(limit: Column | int) -> Column:
    """SC-16: an empty or short page ends the paging."""
    return F.coalesce(F.size(F.from_json("rows_json", "array<string>")), F.lit(0)) < limit


def _decode(rows_json: Column, row_type: str) -> Column:
    # A stray non-object makes the typed decode NULL as a whole; only such
    # lists pay for the second decode element by element.
    strings = F.from_json(rows_json, "array<string>")
    objects = F.filter(strings, lambda e: S.json_text(e).startswith("{"))
    return F.coalesce(
        F.from_json(rows_json, f"array<{row_type}>"),
        F.transform(objects, lambda e: F.from_json(e, row_type)),
    )


def cells(df: DataFrame, text: str = "value", categories: int = 5, keep: tuple[str, ...] = ()) -> DataFrame:
    """SC-01 .. SC-05, SC-16: one row per cell of every accepted document, with its position.

    ``keep`` names document columns to carry along (path, chunk number ...).
    """
    row_type = "struct<" + ",".join(f"`{f.name}`:string" for f in cell_schema(categories)) + ">"
    env = envelope(df, text).filter(~rejected(check_rows=False))
    exploded = env.select(*keep, F.posexplode(_decode(F.col("rows_json"), row_type)).alias("pos", "cell"))
    return exploded.select(*keep, "pos", "cell.*")


def read_cell_lists(spark: SparkSession, path, categories: int = 5) -> DataFrame:
    """SC-03: files that hold a bare JSON list of cells."""
    return spark.read.schema(cell_schema(categories)).option("multiLine", True).json(path)


def _metadata_part(df: DataFrame, text: str, keep: tuple[str, ...], part: str) -> DataFrame:
    """Metadata documents as the kept columns and ``_raw``, the JSON text of one part of them."""
    info = F.from_json(S.json_text(text), _META_ENVELOPE)["GET_META_INFO"]["METADATA_INF"]
    return df.select(*keep, (info["CLASS_INF"]["CLASS_OBJ"] if part == "CLASS_OBJ" else info[part]).alias("_raw"))


def code_list(df: DataFrame, text: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """SC-06: the classes of a metadata document, one row per code, in document order."""
    # Every text is parsed once: each is a column of its own, and a plain explode would parse it again for the filter
    # that Spark infers from it.  The size is taken first, so that no row carries the whole list of its category.
    objects = _metadata_part(df, text, keep, "CLASS_OBJ").select(
        *keep, F.posexplode_outer(F.from_json(as_list(F.col("_raw")), _CLASS_OBJ)).alias("category_pos", "o"))
    members = objects.select(
        *keep,
        "category_pos",
        F.coalesce("o.@id", F.lit("")).alias("category_id"),
        F.coalesce("o.@name", F.lit("")).alias("category_name"),
        F.from_json(as_list(F.col("o.CLASS")), _CLASS).alias("members"),
    )
    sized = members.select("*", F.size("members").alias("category_count"))
    rows = sized.select(
        *keep, "category_pos", "category_id", "category_name", "category_count",
        F.posexplode_outer("members").alias("code_pos", "m"),
    )
    return rows.filter("code_pos IS NOT NULL").select(
        *keep, "category_pos", "code_pos", "category_id", "category_name", "category_count",
        *(
            F.coalesce(F.col("m")[field], F.lit("")).alias(name)
            for field, name in (
                ("@code", "code"), ("@name", "name"), ("@level", "level"),
                ("@parentCode", "parent_code"), ("@unit", "unit"),
            )
        ),
    )


def table_info(df: DataFrame, text: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """PR-17: the flat table description of a metadata document."""
    return _metadata_part(df, text, keep, "TABLE_INF").select(*keep, *M.table_info("_raw"))


def catalogue(df: DataFrame, text: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """SC-07: the tables of a catalogue answer with their position in it."""
    raw = F.from_json(S.json_text(text), _LIST_ENVELOPE)["GET_STATS_LIST"]["DATALIST_INF"]["TABLE_INF"]
    rows = df.select(*keep, F.posexplode(F.from_json(as_list(raw), _TABLE)).alias("position", "t"))
    plain = ("STATISTICS_NAME", "TITLE_SPEC", "DESCRIPTION", "SURVEY_DATE", "OPEN_DATE", "UPDATED_DATE")
    labelled = ("TITLE", "GOV_ORG", "STAT_NAME", "MAIN_CATEGORY", "SUB_CATEGORY")
    return rows.select(
        *keep, "position", F.col("t")["@id"].alias("id"),
        *(S.string_or_object(F.col("t")[f], "").alias(f.lower()) for f in labelled),
        *(F.coalesce(F.col("t")[f], F.lit("")).alias(f.lower()) for f in plain),
    )


def category_sizes(df: DataFrame, text: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """For PR-18: the number of codes of every category of a metadata document, within the row."""
    objects = F.from_json(as_list(F.col("_raw")), _CLASS_OBJ)
    codes = lambda o: F.from_json(as_list(o["CLASS"]), "array<string>")
    size = lambda o: F.coalesce(F.size(codes(o)).cast("bigint"), F.lit(0).cast("bigint"))
    return _metadata_part(df, text, keep, "CLASS_OBJ").select(*keep, F.coalesce(F.transform(objects, size), F.array().cast("array<bigint>")).alias("sizes"))
