"""The registry of the engine's queries: every module of tessella.plans adds its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella import plans


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.run for name, q in plans.registered().items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in plans.registered().items() if q.sql}
