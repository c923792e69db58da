"""The registered queries of the operators here."""

from __future__ import annotations

import importlib

from tidycell.llm.registry import QUERIES, SQL

#: One module per operator.
MODULES = ("op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10", "op11", "op12", "op13")
for _module in MODULES:
    importlib.import_module(f"tidycell.llm.entries.{_module}")

__all__ = ["QUERIES", "SQL"]
