"""Validation rules compiled into few passes: one scan a table for its row rules, one count for all keys, one join for all references."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Reference:
    """A rule on a value: it must be among those that tables provide under the name `to` (a name in SQL), or must not, if forbidden. Null values refer to nothing."""

    rule: str
    level: str
    value: str
    to: str
    where: str = "true"
    forbidden: bool = False


@dataclass(frozen=True)
class Checked:
    """A table with what is checked of it. `rows`: rule, level and the SQL condition of a violation. `unique`: the rule of its key. `provides`:
    name, value and condition (SQL) of what references may point at."""

    table: DataFrame
    key: str
    rows: Sequence[tuple[str, str, str]] = ()
    unique: str | None = None
    references: Sequence[Reference] = ()
    provides: Sequence[tuple[str, str, str]] = field(default=())


def _found(*fields):
    return F.struct(*[f.alias(n) for n, f in zip(("rule", "level", "key"), fields, strict=True)])


def _together(frames: list[DataFrame], none: DataFrame) -> DataFrame:
    out = none
    for f in frames:
        out = out.unionByName(f)
    return out


def violations(tables: Sequence[Checked]) -> DataFrame:
    """rule, level, key of every row that breaks a rule, the key as text; a repeated key once.

    A table's row rules are one array in one scan, whatever their number; a condition that is null isn't broken. The
    keys of all tables are counted in one aggregation, and all references are held against all that is provided in one join on
    name and value (required ones that find nothing, forbidden ones that find something). Values are compared as texts. A value to which
    a third of all rows refer is split by the join as any skewed key is. Empty tables break nothing, but what refers to them does.
    """
    spark = tables[0].table.sparkSession
    none = spark.createDataFrame([], "rule string, level string, key string")
    key = lambda t: F.expr(t.key).cast("string")
    rows = [t.table.select(F.explode(F.array_compact(F.array(*[F.when(F.coalesce(F.expr(c), F.lit(False)), _found(F.lit(r), F.lit(lv), key(t))) for r, lv, c in t.rows]))).alias("x")).select("x.*") for t in tables if t.rows]
    keys = [t.table.select(F.lit(t.unique).alias("rule"), F.lit("error").alias("level"), key(t).alias("key")) for t in tables if t.unique]
    repeated = _together(keys, none).groupBy("rule", "level", "key").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    asked = [
        t.table.select(key(t).alias("key"), F.explode(F.array_compact(F.array(*[F.when(F.expr(f"({r.where}) AND ({r.value}) IS NOT NULL"), F.struct(F.lit(r.rule).alias("rule"), F.lit(r.level).alias("level"), F.expr(r.to).alias("to"), F.expr(r.value).cast("string").alias("value"), F.lit(r.forbidden).alias("forbidden"))) for r in t.references]))).alias("x")).select("key", "x.*")
        for t in tables
        if t.references
    ]
    given = [t.table.select(F.explode(F.array_compact(F.array(*[F.when(F.expr(f"({w}) AND ({v}) IS NOT NULL"), F.struct(F.lit(n).alias("to"), F.expr(v).cast("string").alias("value"))) for n, v, w in t.provides]))).alias("x")).select("x.*") for t in tables if t.provides]
    asked = _together(asked, spark.createDataFrame([], "key string, rule string, level string, to string, value string, forbidden boolean"))
    given = _together(given, spark.createDataFrame([], "to string, value string")).distinct().withColumn("there", F.lit(True))
    held = asked.join(given, ["to", "value"], "left").where(F.col("forbidden") == F.col("there").isNotNull()).select("rule", "level", "key")
    return _together(rows, none).unionByName(repeated).unionByName(held)
