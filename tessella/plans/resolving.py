"""Entity resolution over the driver's tables: what customers would type for their nation or region, against the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators.resolve import resolve
from tessella.plans import query


@query("resolve_mentions")
def resolve_mentions(t):
    """A mention per customer: the nation's name, the same misspelt, or its region's; nations are open in the years of their customers' orders."""
    nation, region = t.nation, t.region
    names = nation.select(F.col("n_name").alias("text"), F.lit("program").alias("entity_type"), F.col("n_nationkey").cast("string").alias("code"), F.lit("unique").alias("resolution"), F.lit("name").alias("kind"))
    groups = region.select(F.col("r_name").alias("text"), F.lit("program_group").alias("entity_type"), F.concat(F.lit("r"), "r_regionkey").alias("code"), F.lit("group").alias("resolution"), F.lit("name").alias("kind"))
    members = nation.select(F.concat(F.lit("r"), "n_regionkey").alias("group_code"), F.col("n_nationkey").cast("string").alias("code"))
    sold = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").cast("string").alias("code"), F.year("o_orderdate").alias("year")).distinct()
    asked = t.customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    kind = F.col("c_custkey") % 3
    mention = F.when(kind == 0, F.col("n_name")).when(kind == 1, F.expr("concat(left(n_name, length(n_name) - 2), reverse(right(n_name, 2)))")).otherwise(F.col("r_name"))
    mentions = asked.select(F.col("c_custkey").alias("mention_id"), mention.alias("mention"), F.lit("program").alias("entity_type"), F.lit(None).cast("array<int>").alias("years"))
    # Each distinct mention is resolved once.
    distinct = mentions.groupBy("mention", "entity_type", "years").agg(F.min("mention_id").alias("mention_id"))
    found = resolve(distinct, names.unionByName(groups), sold, members)
    keys = distinct.select("mention", "entity_type", F.col("mention_id").alias("first_id"))
    return mentions.join(keys, ["mention", "entity_type"]).join(found.withColumnRenamed("mention_id", "first_id"), "first_id").select("mention_id", "mention", "status", "matched_by", "codes", "group_code", "closed")
