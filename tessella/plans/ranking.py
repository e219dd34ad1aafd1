"""Ranked lists with ties, and the statistics of all rows beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.ranking import rank_with_stats
from tessella.plans import query

_TOPK = """
WITH rows AS (SELECT year(o_orderdate)::INTEGER AS year, o_orderpriority AS method, c_name AS program, n_name AS faculty, o_orderkey, o_totalprice::DECIMAL(15,2) AS score
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
ranked AS (SELECT *, rank() OVER (PARTITION BY year, method ORDER BY score {order}) AS rnk,
  count(*) OVER (PARTITION BY year, method) AS n, min(score) OVER (PARTITION BY year, method) AS lowest, max(score) OVER (PARTITION BY year, method) AS highest FROM rows)
SELECT year, method, rnk::INTEGER AS rnk, o_orderkey, program, faculty, score, n, lowest, highest FROM ranked WHERE rnk <= 5
"""


def _top(t, descending: bool) -> DataFrame:
    """Slim orders of known customers are ranked; names are joined to the few rows that stay."""
    placed = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    slim = t.orders.select(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("method"), "o_orderkey", "o_custkey", F.col("o_totalprice").cast("decimal(15,2)").alias("score"))
    slim = slim.join(placed.select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    top = rank_with_stats(slim, ["year", "method"], "score", 5, descending, ties="o_orderkey")
    named = top.join(placed, F.col("o_custkey") == F.col("c_custkey"))
    return named.select("year", "method", "rnk", "o_orderkey", F.col("c_name").alias("program"), F.col("n_name").alias("faculty"), "score", "n", "lowest", "highest")


@query("topk_ties_desc", _TOPK.format(order="DESC"))
def topk_ties_desc(t):
    return _top(t, True)


@query("topk_ties_asc", _TOPK.format(order="ASC"))
def topk_ties_asc(t):
    return _top(t, False)
