"""Queries of the training-data operators, numbered by problem."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: One module per problem; each has QUERIES and may have ORACLES.
MODULES = (
    "linkage",
    "scan_repair",
    "splitting",
    "truncation",
    "fusion",
    "names",
    "venues",
    "packing",
    "leakage",
    "spans",
)


def _modules():
    for name in MODULES:
        yield importlib.import_module(f"litloom.llm.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for module in _modules():
        found.update(module.QUERIES)
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in _modules():
        found.update(getattr(module, "ORACLES", {}))
    return found
