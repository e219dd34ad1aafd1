"""Numbers within groups, however large a group is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values of the order in one range: a group's rows of a range are numbered in one task.
RANGE = 4096


def numbered(df: DataFrame, keys: list[str], order: str, number: str = "k", of: str = "n", width: int = RANGE) -> DataFrame:
    """`df` with the row's number in its group, from 1, in ascending `order` (an integer column without nulls), and the group's size.

    Ranges of the order are counted first: their sums tell how many rows of the group stand before a range, and only a
    range's rows are then sorted together. A group that holds a third of all rows is spread over its ranges. Null keys form a group.
    """
    ranged = df.withColumn("_range", F.floor(F.col(order) / width).cast("long"))
    counts = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("_before", F.sum("_rows").over(before) - F.col("_rows")).withColumn("_all", F.sum("_rows").over(Window.partitionBy(*keys)))
    same = lambda a, b: _all([F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in [*keys, "_range"]])
    both = ranged.alias("r").join(counts.alias("c"), same("r", "c")).select("r.*", "c._before", "c._all")
    place = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(order))
    return both.withColumn(number, place + F.col("_before")).withColumn(of, F.col("_all")).drop("_range", "_before", "_all")


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
