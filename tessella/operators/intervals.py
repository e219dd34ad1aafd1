"""Interval joins without comparing all pairs: values and ranges meet in the nodes of a binary tree over the values' domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of the tree: values are told apart in 2 ** LEVELS cells, and compared exactly within a cell.
LEVELS = 16


def _cells(low: float, high: float, levels: int):
    """The cell of a number; what lies outside low to high is in the first or last one."""
    width = (high - low) / (1 << levels) or 1.0
    return lambda x: F.least(F.greatest(F.floor((x - F.lit(low)) / F.lit(width)).cast("long"), F.lit(0)), F.lit((1 << levels) - 1))


def _nodes(first: Column, last: Column, levels: int) -> Column:
    """The fewest nodes (level, number) that cover the cells first to last: at each level at most one at either end."""

    def at(level):
        size = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        a, z = _shifted(first + size - 1, level), _shifted(last + 1, level)  # half open, ever fewer nodes at either side
        left, right = (a % 2 == 1) & (a < z), (z % 2 == 1) & (a < z)
        node = lambda n: F.struct(level.alias("level"), n.alias("node"))
        return F.array(F.when(left | (level == levels) & (a < z), node(a)), F.when(right & ~(left & (a + 1 == z)) & (level < levels), node(z - 1)))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at)))


def _shifted(x: Column, by: Column) -> Column:
    return F.call_function("shiftright", x, by)


def join_ranges(values: DataFrame, ranges: DataFrame, value: str, lo: str, hi: str, on: list[str] | None = None, levels: int = LEVELS) -> DataFrame:
    """The rows of `values` beside those of `ranges` with lo <= value <= hi (both ends belong to the range; a null end is open), equal in the columns `on`.

    Each range is covered by at most two nodes a level of a binary tree over the values' domain, and each value is in one node a
    level: they meet in an equi-join, in which a pair meets once; within a node the ends are compared. So the work is that of the
    values times the levels, and the pairs that match, however wide or open the ranges are. Null values match nothing, nor do
    ranges whose ends are the wrong way round; repeated rows match as often as they are there. Columns keep their
    names: those of the two sides must differ, but for `on`.
    """
    on = on or []
    low, high = values.agg(F.min(value).cast("double"), F.max(value).cast("double")).first()
    cell = _cells(low or 0.0, high or 0.0, levels)
    v, a, z = F.col(value).cast("double"), F.col(lo).cast("double"), F.col(hi).cast("double")
    mine = values.where(F.col(value).isNotNull()).withColumn("_cell", cell(v)).withColumn("_n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda k: F.struct(k.alias("level"), _shifted(F.col("_cell"), k).alias("node")))))
    first, last = F.when(F.col(lo).isNull(), F.lit(0).cast("long")).otherwise(cell(a)), F.when(F.col(hi).isNull(), F.lit((1 << levels) - 1).cast("long")).otherwise(cell(z))
    theirs = ranges.where(F.col(lo).isNull() | F.col(hi).isNull() | (F.col(lo) <= F.col(hi))).withColumn("_a", first).withColumn("_z", last)
    theirs = theirs.withColumn("_n", F.explode(_nodes(F.col("_a"), F.col("_z"), levels))).select("*", F.col("_n.level").alias("_level"), F.col("_n.node").alias("_node")).drop("_n", "_a", "_z")
    mine = mine.select("*", F.col("_n.level").alias("_level"), F.col("_n.node").alias("_node")).drop("_n", "_cell")
    met = mine.join(theirs, [*on, "_level", "_node"])
    return met.where((F.col(lo).isNull() | (F.col(value) >= F.col(lo))) & (F.col(hi).isNull() | (F.col(value) <= F.col(hi)))).drop("_level", "_node")


def join_overlaps(intervals: DataFrame, ranges: DataFrame, start: str, end: str, lo: str, hi: str, on: list[str] | None = None, levels: int = LEVELS) -> DataFrame:
    """The rows of `intervals` (start to end, a null end open) beside the ranges that they have a point in common with, each pair once.

    Two that overlap do so either where the interval starts, or where the range starts within it, later than the interval: two joins
    of points with ranges. Intervals without a start match nothing; `lo` must not be null.
    """
    on = on or []
    columns = [*intervals.columns, *[c for c in ranges.columns if c not in on]]
    at_start = join_ranges(intervals, ranges, start, lo, hi, on, levels)
    within = join_ranges(ranges.where(F.col(hi).isNull() | (F.col(lo) <= F.col(hi))), intervals, lo, start, end, on, levels).where(F.col(lo) > F.col(start))
    return at_start.select(*columns).unionByName(within.select(*columns))
