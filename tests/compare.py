"""Run registered queries on Spark and their SQL on DuckDB, and compare whole results.

    python -m tests.compare [--sf DIR] [--only PREFIX ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import glob
import math
import os
import sys
import time
from decimal import Decimal

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if hasattr(v, "asDict"):
        return tuple(sorted((k, plain(x)) for k, x in v.asDict().items()))
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    named = [columns[i] for i in order]
    return named, sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


SAME = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


def check(spark, con, name, fn, sql, sf) -> tuple[str, int]:
    df = fn(spark, sf)
    got_names, got = table(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return ("ok (rows only)" if got else "EMPTY"), len(got)
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    want_names, want = table(columns, cur.fetchall())
    if got_names != want_names:
        return f"COLUMNS {got_names} != {want_names}", len(got)
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    duck_types = {d[0]: str(d[1]) for d in cur.description}
    off = [(c, types[c], duck_types[c]) for c in got_names if SAME.get(types[c]) != duck_types[c]]
    if off:
        return f"TYPES {off}", len(got)
    if len(got) != len(want):
        return f"ROWS {len(got)} != {len(want)}; only spark {list(set(map(repr, got)) - set(map(repr, want)))[:2]} only sql {list(set(map(repr, want)) - set(map(repr, got)))[:2]}", len(got)
    for a, b in zip(got, want):
        if a != b:
            return f"VALUES {got_names}: {str(a)[:300]} != {str(b)[:300]}", len(got)
    return ("ok" if got else "EMPTY"), len(got)


def main() -> int:
    from tidycell.session import local_session
    from workloads import QUERIES, SQL

    p = argparse.ArgumentParser()
    p.add_argument("--sf", default="/root/testdata/sf0.01")
    p.add_argument("--only", nargs="*", default=[])
    args = p.parse_args()
    spark = local_session("compare", cores="8")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(args.sf)
    bad = 0
    for name, fn in QUERIES.items():
        if args.only and not any(name.startswith(o) for o in args.only):
            continue
        start = time.time()
        try:
            result, n = check(spark, con, name, fn, SQL.get(name), args.sf)
        except Exception as e:  # report and go on with the next query
            result, n = f"ERROR {type(e).__name__}: {str(e)[:600]}", -1
        bad += not result.startswith("ok")
        print(f"{name:34s} {n:8d} {time.time() - start:6.2f}s {result}", flush=True)
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
