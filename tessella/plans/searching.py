"""Retrieval with branches: ranked lists fused by reciprocal rank, limits of the input, searches per entity, the embedding's self check.

Queries are the rows whose id is divisible by 100, against all rows. What a question asks for stands in its label: years are
label % 3 (newest 2), phrases are labels of the question's own parity, entities are labels.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.search import search
from tessella.plans import query
from tessella.sources.vectors import PAGE, pages

PER_BRANCH, CONSTANT = 20, 60
_COS = "round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6)"
_SCORED = f"s AS (SELECT q.vec_id AS qid, q.label AS asked, e.vec_id, e.label, {_COS} AS score FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)"


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: str, b: str) -> Column:
    return F.round(_dot(a, b) / F.sqrt(_dot(a, a) * _dot(b, b)), 6)


#: Branches as keys of the rows searched and of those that ask, which meet where they are equal.
ALL = ("0", "0")


def only(row: str, asking: str = "true") -> tuple[str, str]:
    """The branch of the rows that fit, for the asking rows that do."""
    return f"CASE WHEN {row} THEN 0 END", f"CASE WHEN {asking} THEN 0 END"


def found(t, branches: list[tuple[str, str]], k: int) -> DataFrame:
    return search(t.embeddings, F.col("vec_id") % 100 == 0, branches, k, tag=F.col("label"))


def fused(t, branches: list[tuple[str, str]], k: int) -> DataFrame:
    """qid, vec_id, rrf, best: the k rows of the largest sum of 1 / (CONSTANT + place) over the branches; best is the exact score."""
    rows = found(t, branches, PER_BRANCH)
    sums = rows.groupBy("qid", "vec_id").agg(F.round(F.sum(1.0 / (CONSTANT + F.col("place"))), 8).alias("rrf"), F.max("score").alias("best"))
    return sums.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rrf"), "vec_id"))).where(F.col("place") <= k).drop("place")


def _fused_sql(branches: list[str], k: int) -> str:
    union = " UNION ALL ".join(f"SELECT qid, vec_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS place FROM s WHERE {b}" for b in branches)
    return f"WITH {_SCORED}, u AS ({union}), f AS (SELECT qid, vec_id, round(sum(1e0 / ({CONSTANT} + place)), 8) AS rrf, max(score) AS best FROM u WHERE place <= {PER_BRANCH} GROUP BY 1, 2) SELECT qid, vec_id, rrf, best FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, vec_id) AS k FROM f) WHERE k <= {k}"


@query("search_branches", _fused_sql(["true", "qid % 200 = 0 AND label % 3 = 2", "label % 2 = asked % 2"], 5))
def search_branches(t):
    """Three branches: all rows; the newest, only if the question names no year (every other one does); rows with the question's phrase."""
    return fused(t, [ALL, only("label % 3 = 2", "vec_id % 200 = 0"), ("label % 2", "label % 2")], 5)


@query("search_faculty", _fused_sql(["label = asked", "label = asked AND vec_id % 5 = 0"], 5))
def search_faculty(t):
    """Two branches: rows of the question's unit, and those of them that introduce it."""
    return fused(t, [("label", "label"), ("CASE WHEN vec_id % 5 = 0 THEN label END", "label")], 5)


@query("search_entities", f"""WITH {_SCORED}, n AS (SELECT qid, asked, 1 + (qid // 100) % 3 AS n FROM (SELECT DISTINCT qid, asked FROM s)), w AS (SELECT s.qid, s.vec_id, s.label, s.score, n.n, (s.label - n.asked + 10) % 10 AS list FROM s JOIN n USING (qid) WHERE (s.label - n.asked + 10) % 10 < n.n),
r AS (SELECT *, row_number() OVER (PARTITION BY qid, list ORDER BY score DESC, vec_id) AS place FROM w)
SELECT qid, vec_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY place, list) AS INTEGER) AS at FROM r WHERE place <= greatest(2, ceil(5.0 / n))""")
def search_entities(t):
    """A search for each of a question's one to three entities, max(2, ceil(5 / n)) rows each, lists taken in turn; not cut to five."""
    rows = found(t, [("label", f"CASE WHEN floor(vec_id / 100) % 3 >= {i} THEN (label + {i}) % 10 END") for i in range(3)], 5)
    asked = (F.floor(F.col("qid") / 100) % 3 + 1).cast("int")
    rows = rows.where(F.col("place") <= F.greatest(F.lit(2), F.ceil(F.lit(5.0) / asked)))
    return rows.select("qid", "vec_id", F.row_number().over(Window.partitionBy("qid").orderBy("place", "branch")).alias("at"))


@query("self_similarity", """WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS a, list_transform(embedding::DOUBLE[], lambda x, i: x + CASE WHEN i = 1 + vec_id % len(embedding) THEN 0.05 * (vec_id % 7) ELSE 0 END) AS b FROM embeddings)
SELECT vec_id, round(list_cosine_similarity(a, b), 6) AS cosine, round(list_cosine_similarity(a, b), 6) >= 0.98 AS ok FROM p""")
def self_similarity(t):
    """Stored vectors against a second embedding of the same text (here: one component moved): those under 0.98 aren't the same model's."""
    again = F.transform("embedding", lambda x, i: x.cast("double") + F.when(i == F.col("vec_id") % F.size("embedding"), 0.05 * (F.col("vec_id") % 7)).otherwise(0.0))
    rows = t.embeddings.select("vec_id", "embedding", again.alias("again")).withColumn("cosine", cosine("embedding", "again"))
    return rows.select("vec_id", "cosine", (F.col("cosine") >= 0.98).alias("ok"))


_ASKED = "SELECT conv_id, turn, CASE WHEN length(text) % 9 = 0 THEN repeat(' ', CAST(turn AS INTEGER)) WHEN length(text) % 9 <> 1 THEN text END AS q, turn % 13 AS k, 1 + length(text) % 5 AS n FROM conversations"


@query("search_limits", f"SELECT conv_id, turn, reason FROM ({_ASKED}) AS i, (VALUES ('empty question'), ('top_k out of 1 to 10'), ('more than 3 entities')) AS r(reason) WHERE (reason = 'empty question' AND trim(coalesce(q, '')) = '') OR (reason = 'top_k out of 1 to 10' AND k NOT BETWEEN 1 AND 10) OR (reason = 'more than 3 entities' AND n > 3)")
def search_limits(t):
    """What is wrong with a search's input: each turn asks with its text, a number of rows and one of entities."""
    size = F.length("text")
    q = F.when(size % 9 == 0, F.repeat(F.lit(" "), F.col("turn").cast("int"))).when(size % 9 != 1, F.col("text"))
    rows = t.conversations.select("conv_id", "turn", q.alias("q"), (F.col("turn") % 13).alias("k"), (1 + size % 5).alias("n"))
    wrong = {"empty question": F.trim(F.coalesce("q", F.lit(""))) == "", "top_k out of 1 to 10": ~F.col("k").between(1, 10), "more than 3 entities": F.col("n") > 3}
    return rows.select("conv_id", "turn", F.explode(F.filter(F.array(*[F.when(c, F.lit(r)) for r, c in wrong.items()]), lambda r: r.isNotNull())).alias("reason"))


# The searches of plans.relational for every row whose id is divisible by 100, against all rows, in blocks.
_S = f"(SELECT q.vec_id AS qid, e.vec_id, e.label, {_COS} AS score FROM embeddings e CROSS JOIN embeddings q WHERE q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id AND {{0}})"
_RANKED = "row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS k"


def _each(name: str, sql: str, run) -> None:
    query(f"{name}_each", sql)(run)


for _name, _where, _row in (("vector_topk", "true", "true"), ("vector_topk_filtered", "e.label IN (1, 2, 3)", "label IN (1, 2, 3)")):
    _each(_name, f"SELECT qid, vec_id, score FROM (SELECT qid, vec_id, score, {_RANKED} FROM {_S.format(_where)} s) r WHERE k <= 10", lambda t, row=_row: found(t, [only(row)], 10).select("qid", "vec_id", "score"))
for _name, _where in (("rrf_general", "label % 2 = 0"), ("rrf_boost", "label < 3"), ("rrf_fusion", "vec_id % 3 = 0")):
    _sql = f"""WITH s AS {_S.format("true")}, u AS (SELECT qid, vec_id, {_RANKED} FROM s UNION ALL SELECT qid, vec_id, {_RANKED} FROM s WHERE {_where}),
    f AS (SELECT qid, vec_id, round(sum(1e0 / (60 + k)), 8) AS rrf FROM u WHERE k <= 20 GROUP BY 1, 2) SELECT qid, vec_id, rrf FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, vec_id) AS k FROM f) r WHERE k <= 5"""
    _each(_name, _sql, lambda t, row=_where: fused(t, [ALL, only(row)], 5).select("qid", "vec_id", "rrf"))
_each("confidence_gate", f"SELECT qid, max(score) AS top, CASE WHEN max(score) < 0.4 THEN 'LOW_RETRIEVAL_CONFIDENCE' ELSE 'ok' END AS status FROM {_S.format('true')} s GROUP BY qid",
      lambda t: found(t, [ALL], 1).select("qid", F.col("score").alias("top"), F.when(F.col("score") < 0.4, "LOW_RETRIEVAL_CONFIDENCE").otherwise("ok").alias("status")))
_each("conflict_flag", f"SELECT qid, count(DISTINCT label) > 1 AS conflict FROM (SELECT qid, label, {_RANKED} FROM {_S.format('true')} s) t WHERE k <= 5 GROUP BY qid",
      lambda t: found(t, [ALL], 5).groupBy("qid").agg((F.count_distinct("tag") > 1).alias("conflict")))


@query("vector_pages", f"SELECT vec_id, CAST((row_number() OVER (ORDER BY sha256(CAST(vec_id AS VARCHAR))) - 1) // {PAGE} AS BIGINT) AS page FROM embeddings WHERE vec_id IS NOT NULL")
def vector_pages(t):
    """The page on which a scroll over the stored points gives each vector."""
    return pages(t.embeddings, "vec_id")
