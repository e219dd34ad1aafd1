"""Text functions, document processing and dialogue over the driver's tables."""

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import chunks
from tessella.functions.text import norm_compact, norm_key, value_range
from tessella.operators.fuzzy import fuzzy_pairs
from tessella.plans import dual, query

_KEYS = "(SELECT doc_id, trim(regexp_replace(strip_accents(replace(lower(text), 'đ', 'd')), '[^a-z0-9]+', ' ', 'g')) AS key FROM documents)"
_head = lambda t: t.documents.select("doc_id", "text")
query("norm_key", f"SELECT doc_id, key FROM {_KEYS}")(lambda t: _head(t).select("doc_id", norm_key(F.col("text")).alias("key")))
query("norm_compact", f"SELECT doc_id, replace(key, ' ', '') AS key FROM {_KEYS}")(lambda t: _head(t).select("doc_id", norm_compact(F.col("text")).alias("key")))
query("strip_lead", f"SELECT doc_id, regexp_replace(key, '^((the|of|and|to) )+', '') AS core FROM {_KEYS}")(lambda t: _head(t).select("doc_id", F.regexp_replace(norm_key(F.col("text")), "^((the|of|and|to) )+", "").alias("core")))


@query("parse_range", """SELECT p_partkey, v.lo, v.hi FROM (SELECT p_partkey, p_partkey % 7 AS k, CAST(p_size AS DOUBLE) AS n FROM part) p, LATERAL (SELECT CASE WHEN k < 2 THEN n + 0.5 WHEN k = 2 THEN n + 0.25 WHEN k <> 5 THEN n END AS lo,
  CASE k WHEN 0 THEN n + 1.5 WHEN 1 THEN n + 2.5 WHEN 2 THEN n + 0.25 WHEN 6 THEN n + 3 END AS hi) v""")
def parse_range(t):
    """Ranges of parts, written in seven ways, read back: two numbers with any dash or a division mark between them, one number, a bound, a word. The SQL has the numbers."""
    k, n = F.col("p_partkey") % 7, F.col("p_size")
    put = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    text = F.when(k == 0, put(n, ".5÷", n + 1, ".5")).when(k == 1, put(n, ",5 - ", n + 2, ",5")).when(k == 2, put(n, ".25")).when(k == 3, put("≥ ", n, ".0")).when(k == 4, put(">", n)).when(k == 5, put("Level ", n)).otherwise(put(n, "–", n + 3))
    lo, hi = value_range(text)
    return t.part.select("p_partkey", lo.alias("lo"), hi.alias("hi"))


dual("first_digit", "SELECT p_partkey, regexp_extract(p_brand, '([0-9])', 1) AS digit FROM {part}")
dual("extract_years", "SELECT page_id, list_sort(list_distinct(list_transform(regexp_extract_all(html, '(?:^|[^0-9])(20[0-9][0-9])\\b', 1), lambda y: CAST(y AS INTEGER)))) AS years FROM {pages}",
     "SELECT page_id, sort_array(array_distinct(transform(regexp_extract_all(html, '(?:^|[^0-9])(20[0-9][0-9])\\\\b', 1), y -> int(y)))) AS years FROM {pages}")
dual("strip_suffix", "SELECT s_suppkey, regexp_replace(s_name, '[0-9]+$', '') AS name FROM {supplier}")
dual("citation", "SELECT doc_id, concat_ws(' — ', source, CASE WHEN doc_id % 2 = 0 THEN 'section ' || doc_id ELSE lang END, CASE WHEN doc_id % 3 = 0 THEN 'page ' || (doc_id % 40) END) AS citation FROM {documents}")
_DEICTIC = "('that', 'this', 'it', 'that one')"
_ASKED = "CASE WHEN length(text) % 5 = 0 THEN 'That?' WHEN length(text) % 5 = 1 THEN ' THÍS – oné! ' WHEN length(text) % 5 = 2 THEN 'that...ONE' ELSE text END"


@query("deictic", f"SELECT conv_id, turn, trim(regexp_replace(strip_accents(replace(lower({_ASKED}), 'đ', 'd')), '[^a-z0-9]+', ' ', 'g')) IN {_DEICTIC} AS deictic FROM conversations")
def deictic(t):
    """Whether a message only points at something, whatever its letter case, accents and marks."""
    return t.conversations.select("conv_id", "turn", norm_key(F.expr(_ASKED)).isin("that", "this", "it", "that one").alias("deictic"))



dual("short_desc", "SELECT doc_id, substr(array_to_string(string_split(text, '. ')[1:2], '. '), 1, 600) AS summary FROM {documents}", "SELECT doc_id, substr(array_join(slice(split(text, '[.] '), 1, 2), '. '), 1, 600) AS summary FROM {documents}")
dual("dedupe_adjacent_lines", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM {documents}) SELECT doc_id, CAST(pos AS INTEGER) AS pos, line FROM (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM l) t WHERE before IS NULL OR before <> line",
     "WITH l AS (SELECT doc_id, posexplode(split(text, '\\n')) AS (pos, line) FROM {documents}) SELECT doc_id, pos, line FROM (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM l) t WHERE before IS NULL OR before <> line")
# Documents
_L = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM {documents})"
_LS = "(SELECT doc_id, posexplode(split(text, '\\n')) AS (pos, line) FROM {documents})"
dual("embed_string", "SELECT doc_id, source || CASE WHEN contains(source, '1') THEN '' ELSE ' 2026' END || ' | ' || lang || chr(10) || text AS s FROM {documents}")


# What SQL can't express
def _best(t, asked, mentions, keys, k: int):
    """The k best keys of each asked mention."""
    pairs = mentions.join(fuzzy_pairs(mentions, keys), "mention").join(keys, "key")
    return pairs.withColumn("k", F.row_number().over(Window.partitionBy(asked).orderBy(F.desc("score"), *keys.columns[::-1]))).where(F.col("k") <= k).drop("k")


@query("fuzzy_join")
def fuzzy_join(t):
    """Nations' names with their last two letters swapped against all names, three at most."""
    names = t.nation.select(norm_key(F.col("n_name")).alias("key"), "n_nationkey")
    mentions = names.select(F.col("n_nationkey").alias("asked"), F.expr("concat(substr(key, 1, length(key) - 2), reverse(right(key, 2)))").alias("mention"))
    return _best(t, "asked", mentions, names, 3).select("asked", "mention", "key", "n_nationkey", "score")


@query("fuzzy_windows")
def fuzzy_windows(t):
    """Parts' names with a letter left out, against names with brand and type in front and behind, so that runs of words decide: each name's five best."""
    names = t.part.select(norm_key(F.concat_ws(" ", "p_type", "p_name", "p_brand")).alias("key")).distinct()
    mentions = t.part.select(F.col("p_name").alias("asked"), F.concat(F.substr("p_name", F.lit(1), F.lit(2)), F.expr("substr(p_name, 4)")).alias("mention")).distinct()
    return _best(t, "asked", mentions, names, 5).select("asked", "mention", "key", "score")


def _of_documents(name: str, f, sql: str | None = None):
    @query(name, sql)
    def run(t):
        udf = F.pandas_udf(lambda s: pd.Series([f(x or "") for x in s]), "array<string>")
        return t.documents.select("doc_id", udf("text").alias("pieces"))


#: A piece starts at the first line with text after the one before, and ends at the first line with which it has {0} characters; a tail of
#: under {1} joins the piece before it. The line that ends a piece is found for each start at once, the recursion only follows them.
_FOLD = """WITH RECURSIVE l AS (SELECT doc_id, i, line, length(line) AS n, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)),
starts AS (SELECT doc_id, i AS s, c - n + {0} AS wanted FROM l WHERE n > 0), e AS (SELECT s.doc_id, s.s, l.i AS e FROM starts s ASOF LEFT JOIN l ON s.doc_id = l.doc_id AND s.wanted <= l.c),
step AS (SELECT e.doc_id, e.s, e.e, n.s AS next FROM e ASOF LEFT JOIN starts n ON e.doc_id = n.doc_id AND e.e < n.s),
r AS (SELECT doc_id, min(s) AS s, 1 AS k FROM starts GROUP BY 1 UNION ALL SELECT r.doc_id, step.next, k + 1 FROM r JOIN step USING (doc_id, s) WHERE step.e IS NOT NULL AND step.next IS NOT NULL),
p AS (SELECT r.doc_id, r.k, step.e IS NULL AS tail, string_agg(l.line, chr(10) ORDER BY l.i) AS piece FROM r JOIN step USING (doc_id, s) JOIN l ON l.doc_id = r.doc_id AND l.i >= r.s AND l.i <= coalesce(step.e, 1000000000) GROUP BY ALL),
m AS (SELECT doc_id, k - CASE WHEN tail AND k > 1 AND length(piece) < {1} THEN 1 ELSE 0 END AS g, k, piece FROM p), j AS (SELECT doc_id, g, string_agg(piece, chr(10) ORDER BY k) AS piece FROM m GROUP BY ALL)
SELECT d.doc_id, coalesce((SELECT list(piece ORDER BY g) FROM j WHERE j.doc_id = d.doc_id), []) AS pieces FROM documents d"""
_of_documents("pack_paragraphs", lambda x: chunks.pack(x.split("\n")), _FOLD.format(chunks.TARGET, chunks.LEAST))
_of_documents("carry_short", lambda x: chunks.carry_short(x.split("\n")), _FOLD.format(chunks.SHORT, 0))
_of_documents("split_clauses", lambda x: chunks.split_clauses("doc", x))
_of_documents("span_scan", lambda x: [f"{a}:{z}:{p}" for a, z, p in chunks.spans(x, ["of the", "the", "in", "de la", "la"])])
