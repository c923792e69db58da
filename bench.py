"""Time the headline jobs and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Every job runs once to warm up, then ``BENCH_RUNS`` times (3 by default); the
median is reported.  Results are consumed in full by the ``noop`` sink, or by
writing and reading back where the job is a load.
"""

from __future__ import annotations

import json
import os
import statistics
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

# Jobs by registered query, with the table whose rows the rate refers to; None is the plain mapped write.
JOBS = {
    "transform_lineitem": ("dm04_labor", "lineitem"),
    "transform_orders": ("dm02_economy", "orders"),
    "decode_documents": ("sc01_envelope_cells", "orders"),
    "quality_gate": ("dq06_gate_passes", "lineitem"),
    "quarantine": ("dq05_quarantine", "orders"),
    "first_per_key": ("wn01_first_per_key", "orders"),
    "partitioned_write": ("sk01_parquet", "orders"),
    "parquet_write": (None, "lineitem"),
    "idempotent_load": ("sk12_idempotent_load", "orders"),
    "csv_export": ("sk03_csv", "orders"),
    "ag03_overview": ("ag03_overview", "orders"),
    "ag09_year_region": ("ag09_year_region_lineitem", "lineitem"),
    "ag14_outliers": ("ag14_outliers_wide", "orders"),
    "jn03_join_and_aggregate": ("jn03_join_and_aggregate", "orders"),
    "jn07_code_dimension": ("jn07_code_dimension", "lineitem"),
    "fl02_resolve_values": ("fl02_resolve_values", "customer"),
    "in11_changes": ("in11_changes", "orders"),
    "search": ("sr09_rerank", "documents"),
    "end_to_end_ingest": ("in12_end_to_end", "orders"),
}


def main() -> None:
    from tidycell.session import local_session, scratch
    from tidycell.sources import files
    from workloads import QUERIES, views

    spark = local_session("bench", cores=CPUS, partitions=int(CPUS) if CPUS.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    rows = {t: spark.read.parquet(f"{SF_DIR}/{t}.parquet").count() for t in {t for _, t in JOBS.values()}}

    def once(name: str | None) -> float:
        start = time.perf_counter()
        if name is None:
            files.write_parquet(views.labor(spark, SF_DIR), scratch(spark, "bench"))
        else:
            QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds, rates = {}, {}
    for job, (name, table) in JOBS.items():
        once(name)
        seconds[job] = round(statistics.median(once(name) for _ in range(RUNS)), 4)
        rates[job] = round(rows[table] / seconds[job])
    print(json.dumps({
        "metric": "headline jobs, total seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "rows_per_sec": rates, "sf": os.path.basename(SF_DIR.rstrip("/")).replace("sf", ""),
        "cpus": CPUS, "runs": RUNS,
    }))


if __name__ == "__main__":
    main()
