"""Queries over the driver's tables, each with its DuckDB counterpart where SQL can express it."""

from __future__ import annotations

import importlib
import pkgutil
import re
from collections.abc import Callable
from dataclasses import dataclass

_found: dict[str, "Query"] = {}


@dataclass(frozen=True)
class Query:
    run: Callable
    sql: str | None


def query(name: str, sql: str | None = None):
    """Registers a function of (tables) under `name`; `sql` is the same result in DuckDB's SQL."""

    def register(f):
        from tessella.sources.tables import Tables

        if name in _found:
            raise ValueError(f"{name} is registered twice")
        _found[name] = Query(lambda spark, sf_dir: f(Tables(spark, sf_dir)), sql)
        return f

    return register


def dual(name: str, sql: str, spark_sql: str | None = None) -> None:
    """Registers one statement for both engines (tables in braces), or two where their dialects differ. Catalyst plans it either way."""
    used = sorted(set(re.findall(r"\{(\w+)\}", sql + (spark_sql or ""))))
    run = lambda t: t.spark.sql(spark_sql or sql, **{x: getattr(t, x) for x in used})
    query(name, re.sub(r"\{(\w+)\}", r"\1", sql))(run)


def registered() -> dict[str, Query]:
    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
    return _found
