"""Mentions to catalogue codes: exact keys, then whole words of a name, then misspelt names; ambiguity asks back."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.text import indel_ratio, norm_key

#: Least key lengths of the stages, least score, lead that decides, distance of candidates, candidates shown.
MIN_WORDS_LEN, MIN_FUZZY_LEN, CUTOFF, MARGIN, CLOSE, SHOWN = 3, 4, 85.0, 10.0, 5.0, 3
#: Kinds of dictionary entries that only match whole.
EXACT_KINDS = ("abbrev", "code")
#: A mention of the first type may also name one of the second.
ALSO = {"program": "program_group"}
LEADS = ("truong", "khoa", "vien", "nganh")


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def core(key: Column, leads: Sequence[str] = LEADS) -> Column:
    """The key without generic words at its start; empty if nothing else is left."""
    words = "|".join(leads)
    return F.regexp_replace(key, f"^(?:(?:{words})(?: |$))+", "")


def resolve(mentions: DataFrame, entries: DataFrame, open_years: DataFrame, members: DataFrame, scoped: str = "program", also: Mapping[str, str] = ALSO, leads: Sequence[str] = LEADS) -> DataFrame:
    """One row per mention: mention_id, status (unique, clarify, group, not_found), matched_by, codes, group_code, closed.

    mentions: mention_id, mention, entity_type, years (null or empty: the last year of open_years). entries: text, entity_type,
    code, resolution (unique, clarify, group), kind. open_years: code, year. members: group_code, code.
    Codes of the type `scoped` count only if open in an asked year; `closed` lists those that the first stage with hits
    lost this way, and an exact but closed hit is never guessed at by spelling. A group of the type also[scoped] gives its
    open members; if several match, the best score, then the smaller code. Null or empty mentions are not_found.

    All joins are equi-joins: on keys, on a mention's first word, and on the lengths that a score of CUTOFF allows.
    """
    wanted = F.create_map(*[F.lit(x) for kv in also.items() for x in kv]) if also else F.lit(None)
    opened = open_years.groupBy("code").agg(F.sort_array(F.collect_set("year")).alias("open"))
    last = open_years.agg(F.max("year").alias("last"))  # one row
    asked = mentions.crossJoin(F.broadcast(last)).select(
        "mention_id", norm_key(F.coalesce("mention", F.lit(""))).alias("asked"),
        F.array_compact(F.array("entity_type", wanted[F.col("entity_type")] if also else F.lit(None).cast("string"))).alias("types"),
        F.when(F.size("years") > 0, F.col("years")).otherwise(F.array("last")).alias("years"))
    known = entries.select(norm_key(F.col("text")).alias("key"), "entity_type", "code", "resolution", "kind").where("key <> ''").distinct()
    names = known.where(~F.col("kind").isin(*EXACT_KINDS))
    q = asked.where("asked <> ''").select("mention_id", "asked", F.explode("types").alias("entity_type"))
    found = ["mention_id", "entity_type", "code", "resolution"]

    exact = q.join(known, (F.col("asked") == F.col("key")) & (q.entity_type == known.entity_type)).select("mention_id", q.entity_type, "code", "resolution", F.lit(1).alias("stage"), F.lit(100.0).alias("score"))
    # A key that holds the mention as whole words holds its first word.
    by_word = names.withColumn("word", F.explode(F.array_distinct(F.split("key", " "))))
    first = q.where(F.length("asked") >= MIN_WORDS_LEN).withColumn("word", F.substring_index("asked", " ", 1))
    within = first.join(by_word, ["word", "entity_type"]).where(F.contains(F.concat(F.lit(" "), "key", F.lit(" ")), F.concat(F.lit(" "), "asked", F.lit(" "))))
    within = within.select(*found, F.lit(2).alias("stage"), _ratio("asked", "key").alias("score"))
    # Spelling: the name's core, or runs of its words about as long as the mention. A score of CUTOFF bounds the lengths' ratio.
    runs = names.withColumn("core", core(F.col("key"), leads)).where("core <> ''").withColumn("w", F.split("core", " ")).withColumn("n", F.size("w"))
    runs = runs.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n")))).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("k") + 1)))
    runs = runs.withColumn("run", F.array_join(F.slice("w", F.col("i"), F.col("k")), " ")).withColumn("len", F.length("run"))
    left = q.join(exact.select("mention_id").distinct(), "mention_id", "left_anti").withColumn("mine", core(F.col("asked"), leads)).where(F.length("mine") >= MIN_FUZZY_LEN)
    left = left.withColumn("qn", F.size(F.split("mine", " "))).withColumn("len", F.explode(F.sequence(F.ceil(F.length("mine") * CUTOFF / (200 - CUTOFF)).cast("int"), F.floor(F.length("mine") * (200 - CUTOFF) / CUTOFF).cast("int"))))
    allowed = (F.col("k") == F.col("n")) | ((F.col("qn") > 1) & (F.col("n") > F.col("qn")) & F.abs(F.col("k") - F.col("qn")).between(0, 1))
    spelt = left.join(runs, ["len", "entity_type"]).where(allowed).select(*found, F.lit(3).alias("stage"), _ratio("mine", "run").alias("score")).where(F.col("score") >= CUTOFF)

    hits = exact.unionByName(within).unionByName(spelt).groupBy(*found, "stage").agg(F.max("score").alias("score"))
    hits = hits.join(asked.select("mention_id", "years"), "mention_id").join(opened, "code", "left")
    hits = hits.withColumn("alive", (F.col("entity_type") != scoped) | F.coalesce(F.arrays_overlap("open", "years"), F.lit(False)))
    # Per mention the dictionary bounds the number of hits.
    rows = hits.groupBy("mention_id").agg(F.collect_list(F.struct("stage", "score", "code", "entity_type", "resolution", "alive")).alias("h"))
    rows = rows.withColumn("live", F.filter("h", lambda x: x["alive"])).withColumn("stage", F.array_min(F.transform("live", lambda x: x["stage"])))
    rows = rows.withColumn("live", F.filter("live", lambda x: x["stage"] == F.col("stage")))
    rows = rows.withColumn("groups", F.filter("live", lambda x: x["resolution"] == "group"))
    big = F.filter("groups", lambda x: x["entity_type"].isin(*also.values()))
    rows = rows.withColumn("group_code", F.array_min(F.transform(big, lambda x: F.struct((-x["score"]).alias("s"), x["code"].alias("c"))))["c"])
    ranked = lambda a: F.array_sort(F.transform(F.array_distinct(F.transform(a, lambda x: x["code"])), lambda c: F.struct((-F.array_max(F.transform(F.filter(a, lambda x: x["code"] == c), lambda x: x["score"]))).alias("s"), c.alias("c"))))
    rows = rows.withColumn("r", ranked(F.col("live")))
    names_of = lambda a: F.transform(a, lambda x: x["c"])
    top = F.col("r")[0]["s"]
    one = (F.size("r") == 1) | ((F.col("stage") == 3) & (F.get("r", F.lit(1))["s"] - top >= MARGIN))
    near = F.when(F.col("stage") == 3, F.filter("r", lambda x: x["s"] - top < CLOSE)).otherwise(F.col("r"))
    codes = (F.when(F.size("groups") > 0, F.array_sort(F.array_distinct(F.transform("groups", lambda x: x["code"]))))
             .when(one, names_of(F.slice("r", 1, 1))).when(F.col("stage") == 1, F.array_sort(names_of(F.col("r")))).otherwise(names_of(F.slice(near, 1, SHOWN))))
    status = F.when(F.size("groups") > 0, "group").when(one, "unique").otherwise("clarify")
    # Closed codes: of the first stage with hits none of which is open, if no stage has open ones.
    lowest = F.array_min(F.transform("h", lambda x: x["stage"]))
    shut = F.when(F.col("stage").isNull(), F.array_sort(F.array_distinct(F.transform(F.filter("h", lambda x: x["stage"] == lowest), lambda x: x["code"]))))
    rows = rows.select("mention_id", F.when(F.col("stage").isNotNull(), status).alias("status"), F.when(F.col("stage") == 1, "exact").when(F.col("stage") == 2, "substring").when(F.col("stage") == 3, "fuzzy").alias("matched_by"), F.when(F.col("stage").isNotNull(), codes).alias("codes"), "group_code", shut.alias("closed"))
    inside = members.join(opened, "code").groupBy("group_code").agg(F.collect_set(F.struct("code", "open")).alias("inside"))
    none = F.array().cast("array<string>")
    out = asked.select("mention_id", "years").join(rows, "mention_id", "left").join(inside, "group_code", "left")
    open_members = F.array_sort(F.transform(F.filter(F.coalesce("inside", F.array().cast(inside.schema["inside"].dataType)), lambda x: F.arrays_overlap(x["open"], F.col("years"))), lambda x: x["code"]))
    return out.select("mention_id", F.coalesce("status", F.lit("not_found")).alias("status"), "matched_by", F.when(F.col("group_code").isNotNull(), open_members).otherwise(F.coalesce("codes", none)).alias("codes"), "group_code", F.coalesce("closed", none).alias("closed"))
