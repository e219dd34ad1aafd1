"""File sources: CSV with an explicit schema, files by year, JSON lines, tables in Markdown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T



def strings(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_csv(spark: SparkSession, path: str | list[str], columns: Sequence[str]) -> DataFrame:
    """All columns as text, in the header's order; a byte order mark before the header is no part of it, empty cells are null.

    The header is checked against `columns` (Spark compares names, so a file with other columns fails instead of shifting).
    """
    return spark.read.schema(strings(columns)).option("header", True).option("enforceSchema", False).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


def read_years(spark: SparkSession, folder: str, prefix: str, columns: Sequence[str]) -> DataFrame:
    """Files prefix_YYYY.csv of one folder, with `year` from the file's name; other names that the glob finds are refused by year null."""
    rows = read_csv(spark, f"{folder}/{prefix}_[0-9][0-9][0-9][0-9].csv", columns)
    return rows.withColumn("year", F.regexp_extract(F.col("_metadata.file_name"), r"_(\d{4})\.csv$", 1).cast("int"))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One record a line by a fixed schema. A line that isn't JSON stops the read: it is never turned into nulls."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def _cells(line: Column) -> Column:
    inner = F.regexp_replace(F.trim(line), r"^\||\|$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|"), lambda c: F.replace(F.trim(c), F.lit("\\|"), F.lit("|")))


def read_markdown_table(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Rows of the tables in Markdown files whose lines have as many cells as `columns`; heads and rules aren't rows."""
    lines = spark.read.text(path).where(F.trim("value").startswith("|"))
    rows = lines.select(_cells(F.col("value")).alias("c")).where(F.size("c") == len(columns))
    is_rule = F.forall("c", lambda x: x.rlike("^:?-+:?$"))
    is_head = F.forall(F.arrays_zip(F.col("c").alias("have"), F.array(*map(F.lit, columns)).alias("want")), lambda x: F.lower(x["have"]) == F.lower(x["want"]))
    return rows.where(~is_rule & ~is_head).select(*[F.col("c")[i].alias(n) for i, n in enumerate(columns)])
