"""Mixing sources to target weights: capped water-filling and a seeded sample of whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm._common import WORD, dropped, saved

WEIGHTS, SHARE, EPOCHS, SEED = (3, 1, 2), 1.5, 2, "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _order(doc_id: Column, seed: str) -> Column:
    """The seeded order of documents: a digest of the id, so that reruns and lost executors give the same sample."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, target: water-filling over the sums of `sizes` (source, size).

    Sources in code-point order (null last) take the weights in turn. A source is clamped at epochs * its size; the
    level for the others, target = weight * level, is the one that spends share * the whole size. Walking the sources
    by clamp / weight, it is the first level that the source at hand doesn't reach its clamp with: the fixed point of
    clamping and resharing again and again. One row per source meets in one window, never the documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("double"))
    per = per.withColumn("clamp", (F.col("source_size") * epochs).cast("double"))
    walk = Window.orderBy((F.col("clamp") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    per = per.select("*", F.row_number().over(walk).alias("k"),
        (F.sum("clamp").over(walk.rowsBetween(Window.unboundedPreceding, 0)) - F.col("clamp")).alias("spent"),
        F.sum("weight").over(walk.rowsBetween(0, Window.unboundedFollowing)).alias("left"),
        (F.sum("source_size").over(everything) * share).alias("budget"))
    per = per.withColumn("level", (F.col("budget") - F.col("spent")) / F.col("left"))
    free = F.when(F.col("level") * F.col("weight") <= F.col("clamp"), F.struct("k", "level"))
    level = F.coalesce(F.min(free).over(everything)["level"], F.lit(float("inf")))
    return per.select("source", "source_size", F.when(F.col("source_size") == 0, 0.0).otherwise(F.least("clamp", F.col("weight") * level)).alias("target"))


def mixture(sizes: DataFrame, seed: str = SEED, partial: bool = True, **how) -> DataFrame:
    """The plan, a row per source: source, source_size, target, whole, cut, rest, tied; with_taken() applies it.

    `sizes` (doc_id, source, size) is a written table. Each document is taken `whole` times; for the fraction that is
    left, documents follow in the seeded order: those before `cut` once more, those at `cut` share `rest` words, `tied`
    being their size together (rows of one doc_id stand at the same place). The place of the cut is found by sums over
    256 ranges of the order in each source, over 256 ranges of one of these, then within one of those: no task holds a
    source, nothing is collected.
    """
    per = targets(sizes, **how)
    per = per.withColumn("words", F.round("target").cast("long"))
    per = per.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("words") / F.col("source_size"))).otherwise(0).cast("long"))
    per = saved(per.withColumn("extra", F.col("words") - F.col("whole") * F.col("source_size")), "mix-sources")
    placed = sizes.select("source", "size", _order(F.col("doc_id"), seed).alias("place"))
    ranges = saved(placed.groupBy("source", F.substring("place", 1, 4).alias("place")).agg(F.sum("size").alias("n")), "mix-places")
    asked = per.where("extra > 0").select("source", F.lit("").alias("range"), F.col("extra").alias("rest"))
    for width in (2, 4):
        asked = _reached(_within(ranges, asked).groupBy("p.source", F.substring("place", 1, width).alias("range"), "rest").agg(F.sum("n").alias("n")), "range", "n")
        asked = asked.select("source", "range", (F.col("rest") - F.col("before")).alias("rest"))
    one = saved(asked, "mix-ranges")
    within = _reached(_within(placed, one).groupBy("p.source", "place", "rest").agg(F.sum("size").alias("tied")), "place", "tied")
    cuts = within.select("source", F.col("place").alias("cut"), (F.col("rest") - F.col("before")).alias("rest"), "tied")
    plan = per.alias("s").join(cuts.alias("c"), F.col("s.source").eqNullSafe(F.col("c.source")), "left")
    rest = F.coalesce("rest", F.lit(0)) if partial else F.when(F.col("rest") * 2 >= F.col("tied"), F.col("tied")).otherwise(0)
    plan = plan.select("s.source", "source_size", "target", "whole", F.coalesce("cut", F.lit("")).alias("cut"), rest.cast("long").alias("rest"), F.coalesce("tied", F.lit(1)).alias("tied"))
    plan = saved(plan, "mix-plan")
    dropped(per, ranges, one)
    return plan


def _within(places: DataFrame, ranges: DataFrame) -> DataFrame:
    """The places (p) that start as their source's range (o) does."""
    return places.alias("p").join(ranges.alias("o"), F.col("p.source").eqNullSafe(F.col("o.source")) & F.col("p.place").startswith(F.col("o.range"))).select("p.*", "o.rest").alias("p")


def _reached(sums: DataFrame, order: str, n: str) -> DataFrame:
    """Of each source, in order, the row in which the sum of n reaches beyond `rest`, with the sum before it."""
    upto = Window.partitionBy("source").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return sums.withColumn("before", F.sum(n).over(upto) - F.col(n)).where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col(n)))


def with_taken(docs: DataFrame, plan: DataFrame, seed: str = SEED, size: str = "size") -> DataFrame:
    """`docs` (doc_id, source, size and more) with the plan's columns and taken, the words that the mix takes of each. Columns of these names are replaced."""
    place = _order(F.col("d.doc_id"), seed)
    # The plan is a small written table: Spark broadcasts it if its files are under the threshold, else it joins by shuffle.
    both = docs.alias("d").join(plan.alias("m"), F.col("d.source").eqNullSafe(F.col("m.source")))
    extra = F.when(place < F.col("m.cut"), F.col(f"d.{size}")).when(place == F.col("m.cut"), F.floor(F.col(f"d.{size}") * F.col("m.rest") / F.col("m.tied"))).otherwise(0).cast("long")
    own = [F.col(f"d.`{c}`") for c in docs.columns if c not in ("source_size", "target", "whole", "extra", "taken")]
    return both.select(*own, "m.source_size", "m.target", "m.whole", extra.alias("extra"), (F.col("m.whole") * F.col(f"d.{size}") + extra).alias("taken"))


def sizes_of(documents: DataFrame) -> DataFrame:
    """The slim table that all passes over sizes read: the texts are read once for it."""
    return saved(documents.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")), "mix-sizes")


def mix(documents: DataFrame, **how) -> DataFrame:
    """The mixed documents, in their own columns: each row as often as the mix takes it; its fraction goes to whole documents.

    Texts of no words (null, empty, white space) take none of the budget: they come `whole` times. An empty table gives none.
    """
    sizes = sizes_of(documents)
    plan = mixture(sizes, partial=False, **how)
    dropped(sizes)
    rows = documents.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    rows = with_taken(rows, plan)
    rows = rows.withColumn("copies", (F.col("whole") + (F.col("extra") > 0).cast("long")).cast("int")).where("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    sizes = sizes_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    plan = mixture(sizes)
    return with_taken(sizes, plan).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')) AS place FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, sum(size)::DOUBLE * 2 AS clamp,
    [3.0, 1.0, 2.0][1 + ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3)]::DOUBLE AS weight FROM sizes GROUP BY source),
walked AS (
  SELECT *, row_number() OVER w AS k, (sum(clamp) OVER (w ROWS UNBOUNDED PRECEDING)) - clamp AS spent,
    sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, (sum(source_size) OVER ()) * 1.5::DOUBLE AS budget
  FROM sources WINDOW w AS (ORDER BY clamp / weight, source ASC NULLS LAST)),
levels AS (SELECT *, (budget - spent) / rest AS level FROM walked),
chosen AS (SELECT level FROM levels WHERE level * weight <= clamp ORDER BY k LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0 ELSE least(clamp, weight * coalesce((SELECT level FROM chosen), 'inf'::DOUBLE)) END::DOUBLE AS target FROM levels),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS whole FROM targets),
summed AS (
  SELECT s.*, p.source_size, p.target, p.whole, round(p.target)::BIGINT - p.whole * p.source_size AS extra,
    sum(size) OVER (PARTITION BY s.source ORDER BY s.place RANGE UNBOUNDED PRECEDING) AS upto,
    sum(size) OVER (PARTITION BY s.source, s.place) AS tied
  FROM sizes s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  (whole * size + CASE WHEN upto <= extra THEN size WHEN upto - tied < extra THEN floor(size * (extra - upto + tied) / tied) ELSE 0 END)::BIGINT AS taken
FROM summed
"""
