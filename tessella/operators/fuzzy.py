"""Fuzzy joins by indel similarity, of whole keys and of their runs of words, found by the bigrams that a near text can't do without."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import ratio


def _grams(text: str, step: int):
    """Bigrams of a text, all or every second one; a text of one letter is its own."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1)), F.lit(step)), lambda i: F.substr(text, i, F.lit(2))))


def key_runs(keys: DataFrame) -> DataFrame:
    """key, words (of the key), run, size (words of the run): every run of a key's words, itself among them."""
    words = keys.select("key", F.split("key", " ").alias("w")).withColumn("words", F.size("w"))
    sized = words.withColumn("size", F.explode(F.sequence(F.lit(1), F.col("words"))))
    runs = sized.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
    return runs.select("key", "words", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("run"), "size").distinct()


def fuzzy_pairs(mentions: DataFrame, keys: DataFrame, least: float = 85.0) -> DataFrame:
    """mention, key, score: pairs of distinct texts (columns `mention` and `key`, words with one space between them) of a score of `least` or more.

    The score is the best indel ratio of the mention with the key, and, for a mention of two words and more and a key of more
    words still, with the key's runs of one word less, as many, and one more. A ratio of s leaves at most (100 - s) % of both lengths
    unmatched, and each unmatched letter can break one of the mention's disjoint bigrams: so of one more than these, one stands
    unbroken in the run. Mentions too short for that meet the runs of near length instead. Runs are filtered, never whole keys, so
    no pair is lost. Null and empty texts match nothing.
    """
    share = 1 - least / 100
    asked = mentions.where("mention <> ''").select("mention").distinct().withColumns({"n": F.size(F.split("mention", " ")), "la": F.length("mention")})
    longest = F.col("la") * (1 + share) / (1 - share)
    broken = F.floor(share * (F.col("la") + longest) + 1e-9).cast("int") + 1
    asked = asked.withColumns({"own": _grams("mention", 2), "broken": broken})
    nearby = F.transform(F.sequence(F.ceil(F.col("la") * (1 - share) / (1 + share) - 1e-9).cast("int"), F.floor(longest + 1e-9).cast("int")), lambda x: F.concat(F.lit("length "), x.cast("string")))
    # Equal bigrams count once in `own`, but only distinct ones are looked up: with enough distinct ones, one of the first is unbroken.
    signs = F.when(F.size("own") >= F.col("broken"), F.slice("own", F.lit(1), F.col("broken"))).otherwise(nearby)
    left = asked.select("mention", "n", "la", F.explode(signs).alias("sign"))
    runs = key_runs(keys.where("key <> ''").select("key").distinct()).withColumn("lb", F.length("run"))
    texts = runs.select("run", "lb", "size").distinct()
    right = texts.withColumn("sign", F.explode(F.concat(_grams("run", 1), F.array(F.concat(F.lit("length "), F.col("lb").cast("string"))))))
    near = 200 * F.least("la", "lb") >= least * (F.col("la") + F.col("lb"))
    met = left.join(right, "sign").where(near).select("mention", "n", "run", "size").distinct()
    scored = met.withColumn("score", ratio("mention", "run")).where(F.col("score") >= least)
    whole = F.col("size") == F.col("words")
    window = (F.col("n") > 1) & (F.col("n") < F.col("words")) & (F.abs(F.col("size") - F.col("n")) <= 1)
    return scored.join(runs.select("key", "words", "run"), "run").where(whole | window).groupBy("mention", "key").agg(F.max("score").alias("score"))
