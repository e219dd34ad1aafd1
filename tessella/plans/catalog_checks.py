"""Queries whose Spark side is more than one statement: bound parameters, incremental loads, fingerprints, coverage, deltas as asked."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.plans import dual, query
from tessella.sources.sinks import changes


@query("param_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice >= 100000 AND year(o_orderdate) = 1997")
def param_scan(t):
    """A statement with named parameters: values, a list among them, are bound, never written into the text."""
    t.orders.createOrReplaceTempView("param_scan_orders")
    args = {"methods": F.array(F.lit("1-URGENT"), F.lit("2-HIGH")), "least": 100_000, "year": 1997}
    return t.spark.sql("SELECT o_orderkey, o_totalprice FROM param_scan_orders WHERE array_contains(:methods, o_orderpriority) AND o_totalprice >= :least AND year(o_orderdate) = :year", args=args)


@query("incremental_diff", """WITH o AS (SELECT doc_id, text, lang, n_chars FROM documents WHERE doc_id % 7 <> 0), n AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN text || '!' ELSE text END AS text, CASE WHEN doc_id % 13 = 0 THEN 'xx' ELSE lang END AS lang, n_chars FROM documents WHERE doc_id % 5 <> 0)
SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN n.doc_id IS NULL THEN 'gone' WHEN n.text IS DISTINCT FROM o.text THEN 'changed' WHEN n.lang IS DISTINCT FROM o.lang OR n.n_chars IS DISTINCT FROM o.n_chars THEN 'flag_flip' ELSE 'same' END AS change FROM n FULL OUTER JOIN o ON n.doc_id = o.doc_id""")
def incremental_diff(t):
    """What an incremental load meets: the operator's own comparison of content and flags."""
    d = t.documents.select("doc_id", "text", "lang", "n_chars")
    new = d.where("doc_id % 5 <> 0").withColumns({"text": F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), "lang": F.when(F.col("doc_id") % 13 == 0, "xx").otherwise(F.col("lang"))})
    return changes(d.where("doc_id % 7 <> 0"), new, "doc_id", ["text"], ["lang", "n_chars"])


_LEAF = "sha256(doc_id || ':' || replace(coalesce(text, ''), chr(13) || chr(10), chr(10)))"


@query("fingerprint", f"WITH l AS (SELECT {_LEAF} AS h FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN replace(text, chr(10), chr(13) || chr(10)) ELSE text END AS text FROM documents)), g AS (SELECT substr(h, 1, 3) AS p, sha256(string_agg(h, '' ORDER BY h)) AS h, count(*) AS n FROM l GROUP BY 1) SELECT sha256(string_agg(h, '' ORDER BY p)) AS fingerprint, CAST(sum(n) AS BIGINT) AS n FROM g")
def fingerprint(t):
    """One digest of a table's content, the same for line ends of either kind (half of the rows have the other here): rows' digests
    are joined in 4,096 ranges of theirs, and those ranges' digests at last."""
    text = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("text"))
    leaf = F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n"))), 256)
    joined = lambda c: F.sha2(F.array_join(F.sort_array(F.collect_list(c)), ""), 256)
    ranges = t.documents.select(leaf.alias("h")).groupBy(F.substring("h", 1, 3).alias("p")).agg(joined("h").alias("h"), F.count("*").alias("n"))
    whole = ranges.agg(F.sort_array(F.collect_list(F.struct("p", "h"))).alias("l"), F.sum("n").alias("n"))
    return whole.select(F.sha2(F.array_join("l.h", ""), 256).alias("fingerprint"), "n")


dual("not_in_anti", """SELECT 'without null' AS list, count(*) AS n FROM {documents} WHERE doc_id NOT IN (SELECT doc_id FROM {labels} WHERE doc_id IS NOT NULL)
UNION ALL SELECT 'with null', count(*) FROM {documents} WHERE doc_id NOT IN (SELECT CASE WHEN doc_id % 10 = 0 THEN NULL ELSE doc_id END FROM {labels})""")

dual("missing_matrix", """WITH asked AS (SELECT c, y, p FROM (VALUES (1), (2), (4), (7), (999999999)) AS a(c) CROSS JOIN (VALUES (1995), (1996), (2030)) AS b(y) CROSS JOIN (VALUES ('1-URGENT'), ('5-LOW'), ('9-NONE')) AS d(p)),
found AS (SELECT DISTINCT o_custkey AS c, year(o_orderdate) AS y, o_orderpriority AS p FROM {orders}),
years AS (SELECT DISTINCT y FROM found), codes AS (SELECT DISTINCT c FROM found), methods AS (SELECT DISTINCT p FROM found)
SELECT asked.c, CAST(asked.y AS INTEGER) AS y, asked.p, CASE WHEN codes.c IS NULL THEN 'unknown_code' WHEN methods.p IS NULL THEN 'unknown_method' WHEN years.y IS NULL THEN 'year_not_covered' ELSE 'no_row' END AS reason
FROM asked LEFT JOIN found ON asked.c = found.c AND asked.y = found.y AND asked.p = found.p LEFT JOIN years ON asked.y = years.y LEFT JOIN codes ON asked.c = codes.c LEFT JOIN methods ON asked.p = methods.p WHERE found.c IS NULL""")


@query("coverage_report", """SELECT source, count(*) AS n, count(lang) AS with_lang, count(*) FILTER (WHERE length(text) > 500) AS with_text, count(*) FILTER (WHERE doc_id % 3 = 0) AS with_label,
  round(100.0 * count(*) FILTER (WHERE length(text) > 500) / count(*), 4) AS text_percent, list_filter([CASE WHEN count(lang) < count(*) THEN 'lang' END, CASE WHEN count(*) FILTER (WHERE length(text) > 500) < count(*) THEN 'text' END, CASE WHEN count(*) FILTER (WHERE doc_id % 3 = 0) < count(*) THEN 'label' END], lambda x: x IS NOT NULL) AS missing FROM documents GROUP BY 1""")
def coverage_report(t):
    """Per source, how many rows have each attribute, the percentage, and which attributes some row lacks."""
    flags = {"lang": F.col("lang").isNotNull(), "text": F.length("text") > 500, "label": F.col("doc_id") % 3 == 0}
    counts = t.documents.groupBy("source").agg(F.count("*").alias("n"), *(F.count_if(c).alias(f"with_{k}") for k, c in flags.items()))
    lacking = F.array_compact(F.array(*(F.when(F.col(f"with_{k}") < F.col("n"), k) for k in flags)))
    return counts.select("source", "n", *(f"with_{k}" for k in flags), F.round(F.lit(100.0) * F.col("with_text") / F.col("n"), 4).alias("text_percent"), lacking.alias("missing"))


_SCALES = "(VALUES ('1-URGENT', 600000), ('2-HIGH', 1200000), ('3-MEDIUM', 900000)) AS s(method, scale)"
dual("yoy_outliers", f"WITH m AS (SELECT o_custkey, o_orderpriority AS method, CAST(year(o_orderdate) AS INTEGER) AS y, min(CAST(o_totalprice AS DECIMAL(15,2))) AS v FROM {{orders}} GROUP BY 1, 2, 3), d AS (SELECT *, v - lag(v) OVER (PARTITION BY o_custkey, method ORDER BY y) AS diff FROM m) SELECT o_custkey, d.method, y, diff FROM d JOIN {_SCALES} ON s.method = d.method WHERE abs(diff) > scale / 6")


@query("usage_counts", """WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2)
SELECT s.source, coalesce(sum(n), 0)::BIGINT AS used, coalesce(list(lang || '=' || n ORDER BY lang) FILTER (WHERE lang IS NOT NULL), []) AS by_lang, coalesce(sum(n), 0) = 0 AS unused FROM (SELECT DISTINCT source FROM documents UNION SELECT 'listed, never used') s LEFT JOIN c ON c.source = s.source WHERE s.source IS NOT NULL GROUP BY 1""")
def usage_counts(t):
    """Of each listed source, its uses by language, and whether it has none."""
    listed = t.documents.select("source").union(t.spark.range(1).select(F.lit("listed, never used"))).where("source IS NOT NULL").distinct()
    counts = t.documents.groupBy(F.col("source").alias("of"), "lang").agg(F.count("*").alias("n"))
    found = listed.join(counts, F.col("source") == F.col("of"), "left").groupBy("source").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("used"), F.sort_array(F.collect_list(F.concat("lang", F.lit("="), "n"))).alias("by_lang"))
    return found.withColumn("unused", F.col("used") == 0)


dual("dedupe_first", "SELECT text, min(doc_id) AS doc_id FROM {documents} GROUP BY text", "SELECT t.text, k.doc_id FROM (SELECT min(doc_id) AS doc_id FROM {documents} GROUP BY sha2(text, 256)) k JOIN {documents} t ON t.doc_id = k.doc_id")

dual("idf_coverage", "WITH w AS (SELECT DISTINCT doc_id, unnest(string_split(lower(text), ' ')) AS g FROM {documents}), n AS (SELECT count(*) AS n FROM {documents}) SELECT g, round(ln((n + 1.0) / (count(*) + 1.0)), 6) AS idf FROM w, n GROUP BY g, n HAVING count(*) >= 5",
     "WITH w AS (SELECT explode(array_distinct(split(lower(text), ' '))) AS g FROM {documents}), c AS (SELECT g, count(*) AS df FROM w GROUP BY g HAVING count(*) >= 5) SELECT g, round(ln((n + 1.0D) / (df + 1.0D)), 6) AS idf FROM c CROSS JOIN (SELECT count(*) AS n FROM {documents}) n")

#: Entities in the order in which they were asked for.
_ASKED = "(VALUES (7, 1), (2, 2), (10, 3), (1, 4), (4, 5)) AS a(c, place)"
dual("pairwise_delta", f"WITH m AS (SELECT c, place, CAST(year(o_orderdate) AS INTEGER) AS y, max(CAST(o_totalprice AS DECIMAL(15,2))) AS v FROM {{orders}} JOIN {_ASKED} ON o_custkey = c GROUP BY 1, 2, 3) SELECT a.c AS c1, b.c AS c2, a.y, b.v - a.v AS diff FROM m a JOIN m b ON a.y = b.y AND a.place < b.place")


@query("project_sections", "SELECT k, CASE WHEN list_contains(s, 'name') THEN s_name END AS name, CASE WHEN list_contains(s, 'place') THEN s_nationkey END AS place, CASE WHEN list_contains(s, 'money') THEN s_acctbal END AS money FROM (SELECT s_suppkey AS k, *, CASE s_suppkey % 3 WHEN 0 THEN ['name'] WHEN 1 THEN ['name', 'place'] ELSE ['money', 'other'] END AS s FROM supplier)")
def project_sections(t):
    """Only the sections that a row's request names."""
    sections = F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit("name"))).when(F.col("s_suppkey") % 3 == 1, F.array(F.lit("name"), F.lit("place"))).otherwise(F.array(F.lit("money"), F.lit("other")))
    only = lambda section, column: F.when(F.array_contains(sections, section), F.col(column)).alias(section)
    return t.supplier.select(F.col("s_suppkey").alias("k"), only("name", "s_name"), only("place", "s_nationkey"), only("money", "s_acctbal"))


@query("subset_test", """WITH c AS (SELECT l_orderkey, list(DISTINCT l_returnflag) AS called, list(DISTINCT l_linestatus) AS kinds FROM lineitem GROUP BY 1) SELECT l_orderkey, list_has_all(called, ['N']) AND list_has_all(['N', 'A'], called) AS between_, list_has_all(kinds, ['F', 'O']) AS superset FROM c""")
def subset_test(t):
    """required <= called <= required and optional, both sides; and whether all kinds are there."""
    rows = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("called"), F.collect_set("l_linestatus").alias("kinds"))
    within = lambda a, b: F.size(F.array_except(a, b)) == 0
    lit = lambda *x: F.array(*map(F.lit, x))
    return rows.select("l_orderkey", (within(lit("N"), F.col("called")) & within(F.col("called"), lit("N", "A"))).alias("between_"), within(lit("F", "O"), F.col("kinds")).alias("superset"))
