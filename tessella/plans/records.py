"""Lines, metadata and references of documents: kinds of lines, defaults, dangling links, codes found in text, places of phrases."""

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import chunks
from tessella.functions.text import norm_key
from tessella.plans import query

_SEEDS = [(-1, "Total    12   34   56   78"), (-2, "1 2 3 4 without wide gaps"), (-3, "In the year 2020 " + "the council met again and again " * 3), (-4, "a   b   c   1 2")]
_SEEDED = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents UNION ALL SELECT k, s, 0 FROM (VALUES " + ", ".join(f"({k}, '{x}')" for k, x in _SEEDS) + ") AS t(k, s))"


@query("line_kind", f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, CASE WHEN len(regexp_extract_all(line, '[0-9]+')) >= 4 AND contains(line, '   ') THEN 'table' WHEN length(line) > 80 AND len(regexp_extract_all(line, '[0-9]+')) <= 2 THEN 'prose' ELSE 'other' END AS kind FROM {_SEEDED}")
def line_kind(t):
    """A table's line has four numbers and a run of three spaces; prose is over 80 characters with two numbers at most."""
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.unionByName(t.spark.createDataFrame(_SEEDS, "doc_id long, line string").withColumn("pos", F.lit(0)))
    n = F.regexp_count("line", F.lit("[0-9]+"))
    return lines.select("doc_id", "pos", F.when((n >= 4) & F.col("line").contains("   "), "table").when((F.length("line") > 80) & (n <= 2), "prose").otherwise("other").alias("kind"))


_RAW = "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 9 = 1 THEN 'draft' ELSE source END AS source, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE lang END AS lang, CASE WHEN doc_id % 6 = 0 THEN '' ELSE 'v' || doc_id % 3 END AS version FROM documents"


@query("fill_defaults", f"SELECT doc_id, CASE WHEN source = 'draft' THEN 'review' WHEN source IS NULL OR source = '' THEN 'unknown' ELSE source END AS source, CASE WHEN lang IS NULL OR lang = '' THEN 'und' ELSE lang END AS lang, CASE WHEN version IS NULL OR version = '' THEN 'v0' ELSE version END AS version, true AS idempotent FROM ({_RAW})")
def fill_defaults(t):
    """Defaults for empty cells only, and one value that is overwritten; filled again, nothing changes."""
    d = F.col("doc_id")
    raw = t.documents.select("doc_id", F.when(d % 4 == 0, "").when(d % 9 == 1, "draft").otherwise(F.col("source")).alias("source"), F.when(d % 5 == 0, None).otherwise(F.col("lang")).alias("lang"), F.when(d % 6 == 0, "").otherwise(F.concat(F.lit("v"), d % 3)).alias("version"))
    defaults = {"source": "unknown", "lang": "und", "version": "v0"}

    def filled(df):
        df = df.withColumns({k: F.coalesce(F.nullif(F.col(k), F.lit("")), F.lit(v)) for k, v in defaults.items()})
        return df.withColumn("source", F.when(F.col("source") == "draft", "review").otherwise(F.col("source")))

    once = filled(raw)
    again = filled(once.withColumns({f"_{k}": F.col(k) for k in defaults}))
    same = F.col("source").eqNullSafe(F.col("_source")) & F.col("lang").eqNullSafe(F.col("_lang")) & F.col("version").eqNullSafe(F.col("_version"))
    return again.select("doc_id", *defaults, same.alias("idempotent"))


#: References that are known to lead nowhere.
IGNORED = ("/the", "/to", "/and")


@query("dangling_refs", """WITH r AS (SELECT page_id, href, min(strpos(html, 'href="' || href || '"')) AS place, any_value(html) AS html FROM (SELECT page_id, html, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM pages) GROUP BY 1, 2)
SELECT page_id, href, substr(html, greatest(1, place - 10)::BIGINT, 60) AS snippet FROM r WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE p.url = r.href) AND lower(href) NOT IN ('/the', '/to', '/and')""")
def dangling_refs(t):
    """References of a page to nothing that was collected, but for those ignored, with the text around the first of them."""
    found = t.pages.select("page_id", "html", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)))).alias("href"))
    at = F.instr("html", F.concat(F.lit('href="'), F.col("href"), F.lit('"')))
    found = found.where(~F.lower("href").isin(*IGNORED)).select("page_id", "href", F.substr("html", F.greatest(F.lit(1), at - 10), F.lit(60)).alias("snippet"))
    known = t.pages.where("url IS NOT NULL").select(F.col("url").alias("known")).distinct()
    return found.join(known, F.col("href") == F.col("known"), "left_anti")


@query("regex_lines", """WITH l AS (SELECT doc_id, pos, line, trim(regexp_replace(strip_accents(replace(lower(line), 'đ', 'd')), '[^a-z0-9]+', ' ', 'g')) AS key FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents) WHERE regexp_matches(line, '^[A-Z][a-z]+ '))
SELECT doc_id, CAST(pos AS INTEGER) AS pos, line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY pos) AS k FROM l) WHERE k = 1""")
def regex_lines(t):
    """Lines of a pattern, the first of those that are equal but for letter case, accents and marks."""
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.col("line").rlike("^[A-Z][a-z]+ "))
    first = lines.groupBy("doc_id", norm_key(F.col("line")).alias("key")).agg(F.min_by("line", "pos").alias("line"), F.min("pos").alias("pos"))
    return first.select("doc_id", "pos", "line")


_CODES = [("Brand#1", "hot brass pipe"), ("Brand#13", "cold steel"), ("W-1", "cold widget"), ("W-2", "small grey widget"), ("B-1", "large hex bolt"), ("SOLO", "gear"), ("Brand#19", "tiny bolt")]


@query("token_overlap_match", "WITH c(code, name) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _CODES) + """), p AS (SELECT p_partkey, p_brand || ' ' || p_name AS s, p_name FROM part),
inside AS (SELECT p_partkey, code FROM (SELECT p.p_partkey, c.code, row_number() OVER (PARTITION BY p_partkey ORDER BY length(code) DESC, code) AS k FROM p JOIN c ON contains(' ' || s || ' ', ' ' || code || ' ')) WHERE k = 1),
o AS (SELECT p.p_partkey, c.code, len(list_intersect(list_distinct(string_split(c.name, ' ')), string_split(p.p_name, ' '))) AS n, len(list_distinct(string_split(c.name, ' '))) AS size FROM p CROSS JOIN c WHERE p.p_partkey NOT IN (SELECT p_partkey FROM inside) AND len(string_split(c.name, ' ')) >= 2),
best AS (SELECT p_partkey, code FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY n DESC, n * 1.0 / size DESC, code) AS k FROM o WHERE n > 0 AND n * 1.0 / size >= 0.6) WHERE k = 1)
SELECT p_partkey, code, 'code' AS by FROM inside UNION ALL SELECT p_partkey, code, 'name' FROM best""")
def token_overlap_match(t):
    """The longest code that stands in a text by itself; else the name that shares most words with it, of 60 % of its words and more.
    Names of one word don't match. The catalogue is the small side."""
    codes = F.broadcast(t.spark.createDataFrame(_CODES, "code string, name string"))
    text = t.part.select("p_partkey", "p_name", F.concat(F.lit(" "), "p_brand", F.lit(" "), "p_name", F.lit(" ")).alias("s"))
    inside = text.join(codes, F.contains("s", F.concat(F.lit(" "), "code", F.lit(" ")))).groupBy("p_partkey").agg(F.max_by("code", F.struct(F.length("code"), "code")).alias("code"))
    words = text.join(inside.select("p_partkey"), "p_partkey", "left_anti").select("p_partkey", F.explode(F.array_distinct(F.split("p_name", " "))).alias("word"))
    names = t.spark.createDataFrame(_CODES, "code string, name string").select("code", F.array_distinct(F.split("name", " ")).alias("w")).where(F.size("w") >= 2).select("code", F.size("w").alias("size"), F.explode("w").alias("word"))
    hits = words.join(F.broadcast(names), "word").groupBy("p_partkey", "code", "size").agg(F.count("*").alias("n")).where("n / size >= 0.6")
    best = hits.withColumn("k", F.row_number().over(Window.partitionBy("p_partkey").orderBy(F.desc("n"), (F.col("n") / F.col("size")).desc(), "code"))).where("k = 1")
    return inside.select("p_partkey", "code", F.lit("code").alias("by")).unionByName(best.select("p_partkey", "code", F.lit("name").alias("by")))


@query("span_scan_folded")
def span_scan_folded(t):
    """Places, in the text as it stands, of phrases found whatever the letter case and accents."""
    udf = F.pandas_udf(lambda s: pd.Series([[f"{a}:{z}:{p}" for a, z, p in chunks.folded_spans(x or "", ["of the", "the", "fur", "de la", "la"])] for x in s]), "array<string>")
    return t.documents.select("doc_id", udf("text").alias("pieces"))
