"""All queries of the engine by name, and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules of this package that hold queries.
MODULES = ("nested_plans", "scan_plans", "graph_plans", "rollup_plans", "search_plans", "diff_plans", "source_plans", "flow_plans", "link_plans", "insight_plans")


def _parts() -> list:
    return [import_module(f"tessera.plans.{m}") for m in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for part in _parts() for name, q in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _parts() for name, sql in part.SQL.items()}
