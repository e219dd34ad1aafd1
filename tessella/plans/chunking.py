"""Chunks of documents by their structure, with their text; locators, pages and coverage of chunks; numbers of duplicates.

The handbooks are `documents` with headings put in: line 0 of every 21 opens a chapter, line 1 of every 7 an article, some lines are
those of a table of contents; ten lines are a page.
"""

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import chunks
from tessella.operators.numbering import numbered
from tessella.plans import query

LEAST_ARTICLE, LEAST_CAPS = 60, 120
_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents"
_BOOK = f"""SELECT doc_id, pos, pos // 10 + 1 AS page, CASE WHEN pos % 21 = 2 THEN 'CHAPTER ' || (pos // 21 + 1) WHEN pos % 7 = 3 THEN 'Article ' || (pos // 7 + 1) || '. ' || raw WHEN pos % 13 = 5 THEN raw || ' ..... ' || pos ELSE raw END AS line FROM ({_LINES})"""
_SEGMENTS = f"""SELECT *, sum(CASE WHEN regexp_matches(line, '^Article [0-9]+[.]') THEN 1 ELSE 0 END) OVER w AS seg, last_value(CASE WHEN line LIKE 'CHAPTER %' THEN line END IGNORE NULLS) OVER w AS chapter FROM ({_BOOK}) WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)"""
_ARTICLES = f"""SELECT doc_id, regexp_extract(first(line ORDER BY pos), '^Article ([0-9]+)', 1) AS article, first(chapter ORDER BY pos) AS chapter, first(page ORDER BY pos) AS page, string_agg(line, chr(10) ORDER BY pos) AS text
  FROM ({_SEGMENTS}) WHERE seg > 0 AND line NOT LIKE 'CHAPTER %' AND NOT regexp_matches(line, '[.]{{3,}} *[0-9]+$') GROUP BY doc_id, seg HAVING length(string_agg(line, chr(10) ORDER BY pos)) >= {LEAST_ARTICLE} AND first(chapter ORDER BY pos) IS NOT NULL"""


def _lines(t):
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))


def _book(t):
    pos, raw = F.col("pos"), F.col("raw")
    line = F.when(pos % 21 == 2, F.concat(F.lit("CHAPTER "), F.floor(pos / 21) + 1)).when(pos % 7 == 3, F.concat(F.lit("Article "), F.floor(pos / 7) + 1, F.lit(". "), raw)).when(pos % 13 == 5, F.concat(raw, F.lit(" ..... "), pos)).otherwise(raw)
    return _lines(t).select("doc_id", "pos", (F.floor(pos / 10) + 1).cast("int").alias("page"), line.alias("line"))


def _articles(t):
    """Chunks from one article's heading to the next, under the chapter and page at which they start; no contents lines, nothing
    before the first chapter, no article of under LEAST_ARTICLE characters."""
    upto = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    chapter = F.last(F.when(F.col("line").startswith("CHAPTER "), F.col("line")), ignorenulls=True).over(upto)
    rows = _book(t).select("*", F.count_if(F.col("line").rlike("^Article [0-9]+[.]")).over(upto).alias("seg"), chapter.alias("chapter"))
    rows = rows.where((F.col("seg") > 0) & ~F.col("line").startswith("CHAPTER ") & ~F.col("line").rlike("[.]{3,} *[0-9]+$"))
    found = rows.groupBy("doc_id", "seg").agg(F.sort_array(F.collect_list(F.struct("pos", "line", "chapter", "page"))).alias("l"))
    first = lambda k: F.col("l")[0][k]
    found = found.select("doc_id", F.regexp_extract(first("line"), "^Article ([0-9]+)", 1).alias("article"), first("chapter").alias("chapter"), first("page").alias("page"), F.array_join("l.line", "\n").alias("text"))
    return found.where((F.length("text") >= LEAST_ARTICLE) & F.col("chapter").isNotNull())


@query("chunk_by_heading", f"SELECT doc_id, article, chapter, CAST(page AS INTEGER) AS page, text FROM ({_ARTICLES})")
def chunk_by_heading(t):
    return _articles(t)


_CAPS = "upper(raw) = raw AND lower(raw) <> raw"


@query("chunk_by_caps", f"""WITH s AS (SELECT *, sum(CASE WHEN {_CAPS} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS seg FROM ({_LINES}))
SELECT doc_id, CAST(seg AS INTEGER) AS seg, max(CASE WHEN {_CAPS} THEN raw END) AS heading, string_agg(raw, chr(10) ORDER BY pos) AS text FROM s GROUP BY doc_id, seg HAVING length(string_agg(raw, chr(10) ORDER BY pos)) >= {LEAST_CAPS}""")
def chunk_by_caps(t):
    """Chunks from one all-capitals line to the next, of LEAST_CAPS characters and more."""
    caps = (F.upper("raw") == F.col("raw")) & (F.lower("raw") != F.col("raw"))
    rows = _lines(t).withColumn("seg", F.count_if(caps).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    found = rows.groupBy("doc_id", "seg").agg(F.max(F.when(caps, F.col("raw"))).alias("heading"), F.sort_array(F.collect_list(F.struct("pos", "raw"))).alias("l"))
    return found.select("doc_id", "seg", "heading", F.array_join("l.raw", "\n").alias("text")).where(F.length("text") >= LEAST_CAPS)


@query("merge_continued", """WITH a AS (SELECT conv_id, turn, turn // 3 AS article, 'Article ' || (turn // 3) || CASE WHEN turn % 3 > 0 THEN ' (continued)' ELSE '' END || chr(10) || text AS chunk FROM conversations)
SELECT conv_id, 'Article ' || article AS heading, count(*) AS parts, string_agg(regexp_replace(chunk, '^Article [0-9]+( [(]continued[)])?\\n', ''), chr(10) ORDER BY turn) AS text FROM a GROUP BY conv_id, article""")
def merge_continued(t):
    """Articles that go on under "(continued)" become one: by number, in order, each heading once."""
    own = F.concat(F.lit("Article "), F.floor(F.col("turn") / 3))
    rows = t.conversations.select("conv_id", "turn", F.concat(own, F.when(F.col("turn") % 3 > 0, " (continued)").otherwise(""), F.lit("\n"), "text").alias("chunk"))
    rows = rows.withColumn("heading", F.regexp_extract("chunk", "^(Article [0-9]+)", 1)).withColumn("body", F.regexp_replace("chunk", "^Article [0-9]+( [(]continued[)])?\n", ""))
    found = rows.groupBy("conv_id", "heading").agg(F.count("*").alias("parts"), F.sort_array(F.collect_list(F.struct("turn", "body"))).alias("l"))
    return found.select("conv_id", "heading", "parts", F.array_join("l.body", "\n").alias("text"))


@query("chunk_ids", f"""WITH a AS (SELECT doc_id, article, page, 'doc-' || (doc_id % 5) || '::' || CASE WHEN doc_id % 4 = 0 THEN 'part' ELSE 'article-' || article END AS key, doc_id % 4 = 0 AS always, doc_id * 100000 + CAST(article AS BIGINT) AS ord FROM ({_ARTICLES}))
SELECT doc_id, article, key || CASE WHEN always OR count(*) OVER (PARTITION BY key) > 1 THEN '-' || row_number() OVER (PARTITION BY key ORDER BY ord) ELSE '' END AS chunk_id FROM a""")
def chunk_ids(t):
    """Locators slug::place; a number follows where a locator repeats, or the kind (part) is always numbered. Pieces are numbered after that."""
    part = F.col("doc_id") % 4 == 0
    place = F.when(part, "part").otherwise(F.concat(F.lit("article-"), "article"))
    rows = _articles(t).select("doc_id", "article", F.concat(F.lit("doc-"), F.col("doc_id") % 5, F.lit("::"), place).alias("key"), part.alias("always"), (F.col("doc_id") * 100000 + F.col("article").cast("long")).alias("ord"))
    rows = numbered(rows, ["key"], "ord", width=10**7)
    return rows.select("doc_id", "article", F.concat("key", F.when(F.col("always") | (F.col("n") > 1), F.concat(F.lit("-"), "k")).otherwise("")).alias("chunk_id"))


@query("number_duplicates", "SELECT doc_id, source || '::' || lang || CASE WHEN lang = 'de' OR count(*) OVER (PARTITION BY source, lang) > 1 THEN '-' || row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) ELSE '' END AS id FROM documents")
def number_duplicates(t):
    """Names with a number where they repeat, or always for one kind; groups of any size."""
    rows = numbered(t.documents.select("doc_id", "source", "lang"), ["source", "lang"], "doc_id")
    return rows.select("doc_id", F.concat("source", F.lit("::"), "lang", F.when((F.col("lang") == "de") | (F.col("n") > 1), F.concat(F.lit("-"), "k")).otherwise("")).alias("id"))


@query("order_nulls_last", "SELECT doc_id, quality, row_number() OVER (ORDER BY quality ASC NULLS LAST, doc_id) AS place FROM documents LEFT JOIN labels USING (doc_id)")
def order_nulls_last(t):
    """Places in the order of quality, unknown last: the rows of smaller qualities are counted, those of one quality are numbered by ranges."""
    rows = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    ahead = Window.orderBy(F.col("quality").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    sizes = rows.groupBy("quality").agg(F.count("*").alias("size")).withColumn("ahead", F.sum("size").over(ahead) - F.col("size"))  # a row per quality
    placed = numbered(rows, ["quality"], "doc_id").alias("r").join(F.broadcast(sizes.alias("s")), F.col("r.quality").eqNullSafe(F.col("s.quality")))
    return placed.select("r.doc_id", "r.quality", (F.col("ahead") + F.col("k")).alias("place"))


@query("attribute_page", f"""WITH b AS ({_BOOK}), u AS (SELECT doc_id, line, min(page) AS page FROM b WHERE length(line) > 20 GROUP BY 1, 2 HAVING count(*) = 1),
c AS (SELECT doc_id, article, unnest(string_split(text, chr(10))) AS line FROM ({_ARTICLES})), h AS (SELECT c.doc_id, c.article, u.page, count(*) AS n FROM c JOIN u USING (doc_id, line) GROUP BY ALL),
m AS (SELECT doc_id, article, first(page ORDER BY n DESC, page) AS mode FROM h GROUP BY 1, 2)
SELECT doc_id, article, CAST(mode AS INTEGER) AS mode, CAST(min(page) AS INTEGER) AS first_page, CAST(max(page) AS INTEGER) AS last_page FROM h JOIN m USING (doc_id, article) WHERE abs(page - mode) <= 2 GROUP BY 1, 2, 3""")
def attribute_page(t):
    """Pages of each article from its lines that stand on one page only: the most frequent page, and those found within two of it."""
    once = _book(t).where(F.length("line") > 20).groupBy("doc_id", "line").agg(F.min("page").alias("page"), F.count("*").alias("n")).where("n = 1").drop("n")
    hits = _articles(t).select("doc_id", "article", F.explode(F.split("text", "\n")).alias("line")).join(once, ["doc_id", "line"]).groupBy("doc_id", "article", "page").agg(F.count("*").alias("n"))
    hits = hits.withColumn("mode", F.max(F.struct("n", (-F.col("page")).alias("minus"))).over(Window.partitionBy("doc_id", "article")))
    near = hits.withColumn("mode", -F.col("mode.minus")).where(F.abs(F.col("page") - F.col("mode")) <= 2)
    return near.groupBy("doc_id", "article", "mode").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"))


@query("text_coverage", f"""WITH b AS ({_BOOK}), c AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM ({_ARTICLES}))
SELECT doc_id, count(*) AS missing, min(pos) AS first_missing FROM b WHERE length(trim(line)) > 0 AND NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = b.doc_id AND c.line = b.line) GROUP BY 1""")
def text_coverage(t):
    """Lines of the source that no chunk of the document holds, per document."""
    held = _articles(t).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    lost = _book(t).where(F.length(F.trim("line")) > 0).join(held, ["doc_id", "line"], "left_anti")
    return lost.groupBy("doc_id").agg(F.count("*").alias("missing"), F.min("pos").cast("long").alias("first_missing"))


@query("split_long")
def split_long(t):
    """Documents in pieces near a length, cut at lines, with the prefix and a table's header repeated."""
    udf = F.pandas_udf(lambda s: pd.Series([chunks.split_long(x or "", "[doc]") for x in s]), "array<string>")
    return t.documents.select("doc_id", udf("text").alias("pieces"))
