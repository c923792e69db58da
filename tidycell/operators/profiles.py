"""Column profiles (PR-13 over whole columns)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidycell.functions import scalars as S

# From narrow to wide; a column takes the widest type of its values.
TYPES = ("INT", "DOUBLE", "TIMESTAMP", "STRING")


def column_types(df: DataFrame) -> DataFrame:
    """PR-13: the inferred type of every text column, ``(column_name, type)``, from one aggregation."""
    kinds = F.array(*map(F.lit, TYPES))
    widest = [F.max(F.array_position(kinds, S.text_type(f"`{c}`"))).alias(c) for c in df.columns]
    one = df.agg(*widest)
    pairs = F.array(*(
        F.struct(F.lit(c).alias("column_name"), F.coalesce(F.try_element_at(kinds, F.col(f"`{c}`").cast("int")), F.lit("STRING")).alias("type"))
        for c in df.columns
    ))
    return one.select(F.explode(pairs).alias("p")).select("p.column_name", "p.type")
