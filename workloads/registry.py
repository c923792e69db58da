"""Registration of queries and composition of their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    """A named subquery that other SQL may use; it may use the ones defined before it."""
    VIEWS[name] = sql.strip()


def _used(sql: str) -> set[str]:
    words = set(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", sql))
    return {v for v in VIEWS if v in words}


def compose(sql: str) -> str:
    """Put the views a statement needs in front of it."""
    needed: set[str] = set()
    todo = [sql]
    while todo:
        for name in _used(todo.pop()) - needed:
            needed.add(name)
            todo.append(VIEWS[name])
    if not needed:
        return sql.strip()
    parts = ",\n".join(f"{n} AS (\n{VIEWS[n]}\n)" for n in VIEWS if n in needed)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {parts},\n{body[5:]}"
    return f"WITH {parts}\n{body}"


PLACES = 4


def finely(fn):
    """The query with its finished doubles rounded to ``PLACES``, as its SQL rounds them: two engines'
    sums of the same figures differ in the last bits."""
    @wraps(fn)
    def run(spark, sf):
        df = fn(spark, sf)
        return df.select(*(F.round(c, PLACES).alias(c) if t == "double" else c for c, t in df.dtypes))

    return run


def query(name: str, sql: str | None = None, fine: bool = False):
    """Register a Spark query and, where plain SQL can say the same, that SQL."""
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = finely(fn) if fine else fn
        if sql is not None:
            SQL[name] = compose(sql)
        return fn

    return wrap
