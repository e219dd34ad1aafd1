"""What the relational tools share: mentions to codes, and one envelope for every answer.

An envelope is a row per request: status, data, missing, clarifications, sources. A request with an ambiguous mention is asked back
and has no data at all; data with something missing is partial; without data it is not_found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Candidates that a mention which is only part of names is asked back with, at most.
CANDIDATES = 3


def plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def resolved(mentions: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of mentions (req, mention) and a catalog (code, name): found (req, code), clarify (req, candidate), unknown (req, mention).

    The whole name decides first, by an equality join; only mentions that are nobody's whole name are looked for as whole
    words within names, and these are few: requests are the small side of that join.
    """
    asked = mentions.where("mention IS NOT NULL").withColumn("k", plain(F.col("mention")))
    names = catalog.select("code", "name", plain(F.col("name")).alias("key"))
    whole = asked.join(names, F.col("k") == F.col("key")).select("req", "code", "name", F.lit(True).alias("whole"))
    rest = asked.join(whole.select("req").distinct(), "req", "left_anti").where(F.length("k") >= 3)
    within = names.join(F.broadcast(rest), F.contains(F.concat(F.lit(" "), "key", F.lit(" ")), F.concat(F.lit(" "), "k", F.lit(" "))))
    hits = whole.unionByName(within.select("req", "code", "name", F.lit(False).alias("whole"))).distinct()
    counts = hits.groupBy("req").agg(F.count("*").alias("n"), F.min("code").alias("only"))
    found = counts.where("n = 1").select("req", F.col("only").alias("code"))
    several = hits.join(counts.where("n > 1").select("req"), "req")
    place = F.row_number().over(Window.partitionBy("req").orderBy("name", "code"))
    clarify = several.withColumn("k", place).where(F.col("whole") | (F.col("k") <= CANDIDATES)).select("req", F.col("name").alias("candidate"))
    return found, clarify, asked.join(counts.select("req"), "req", "left_anti").select("req", "mention")


def envelope(requests: DataFrame, data: DataFrame, missing: DataFrame, clarify: DataFrame) -> DataFrame:
    """req, status, data, missing, clarifications, sources of each request (req). data has req, row, source; missing req, item,
    reason; clarify req, candidate. Lists are sorted; equal sources, rows and reasons stand once."""
    gathered = lambda df, column, name: df.groupBy("req").agg(F.sort_array(F.collect_set(column)).alias(name))
    open_ = clarify.select("req").distinct()
    data, missing = data.join(open_, "req", "left_anti"), missing.join(open_, "req", "left_anti")
    out = requests.select("req").distinct()
    for df, column, name in ((data, F.col("row"), "data"), (missing, F.concat_ws(": ", "item", "reason"), "missing"), (clarify, F.col("candidate"), "clarifications"), (data, F.col("source"), "sources")):
        out = out.join(gathered(df, column, name), "req", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    status = F.when(F.size("clarifications") > 0, "ambiguous").when(F.size("data") == 0, "not_found").when(F.size("missing") > 0, "partial").otherwise("ok")
    return out.select("req", status.alias("status"), "data", "missing", "clarifications", "sources")


def invalid(requests: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """missing rows (req, item, reason) of requests that break an input limit: rules maps a reason to what breaks it."""
    broken = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for r, c in rules.items())))
    return requests.select("req", F.lit("input").alias("item"), F.explode(broken).alias("reason"))
