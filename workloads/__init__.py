"""The registered queries: each operator over the given tables, with the same thing in plain SQL."""

from __future__ import annotations

import importlib

from workloads.registry import QUERIES, SQL

for _module in ("scalars", "scans", "sinks", "selection", "joins", "statistics", "checks", "catalogue", "ingestion"):
    importlib.import_module(f"workloads.{_module}")

__all__ = ["QUERIES", "SQL"]
