"""Every query of the library by name, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("rollup", "statistics", "scorecard", "consensus", "history", "text", "records", "scalars", "streams", "sources", "floors", "reports", "mappings", "plugins")


def _all() -> dict:
    return {name: pair for m in MODULES for name, pair in import_module(f"assaylake.plans.{m}").QUERIES.items()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: pair[0] for name, pair in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: pair[1] for name, pair in _all().items() if pair[1]}
