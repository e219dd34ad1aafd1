"""Ranks with ties."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rank_with_stats(rows: DataFrame, by: Sequence[str], value: str, limit: int, descending: bool = True, ties: str | None = None) -> DataFrame:
    """Rows of rank at most `limit` in their group (equal values share a rank, and all of them stay), with rnk and the
    group's n, lowest and highest over all its rows. Null values aren't ranked.

    The statistics are an aggregate of their own: beside them in one window Spark couldn't limit groups before the shuffle.
    """
    rows = rows.where(F.col(value).isNotNull())
    stats = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min(value).alias("lowest"), F.max(value).alias("highest"))
    order = F.col(value).desc() if descending else F.col(value).asc()
    top = rows.withColumn("rnk", F.rank().over(Window.partitionBy(*by).orderBy(order))).where(F.col("rnk") <= limit)
    return top.join(stats, list(by))
