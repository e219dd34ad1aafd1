"""Pages read as trees, and sentences scanned for names: over the given tables, and over pages and sentences that Spark writes from them."""

import pandas as pd
from pyspark.sql import functions as F

from tessella.functions import html
from tessella.operators.scan import scan_sentences
from tessella.plans import query


def _stage(f, kind: str):
    """One Arrow stage for all columns that a page gives."""
    return F.pandas_udf(lambda *cols: pd.Series([f(*x) for x in zip(*cols, strict=True)]), kind)


# Pages
query("html_text")(lambda t: t.pages.select("page_id", _stage(html.main_text, "string")("html").alias("value")))
query("html_links")(lambda t: t.pages.select("page_id", _stage(lambda h, u: [f"{x} {y}" for x, y in html.links(h, u, least=6, keep="^https?://")], "array<string>")("html", "url").alias("value")))
query("html_facts")(lambda t: t.pages.select("page_id", _stage(lambda h: [f"{k}={v}" for k, v in html.facts(h).items()], "array<string>")("html").alias("value")))
query("html_tables")(lambda t: t.pages.select("page_id", _stage(lambda h: ["|".join(r) for x in html.tables(h) for r in x], "array<string>")("html").alias("value")))


@query("html_main")
def html_main(t):
    """Pages whose article has a class: its container counts, if it has 500 characters, and marked lines go."""
    as_article = F.regexp_replace("html", "<article>", '<article class="x post">')
    return t.pages.select("page_id", _stage(lambda h: html.main_text(h, spam=r"\*\*\*|###"), "string")(as_article).alias("value"))


#: Suppliers to a page, so that a page has a bound whatever its nation's share.
_PER_PAGE = 500


@query("html_table_rows", f"""SELECT s_nationkey, CAST(s_suppkey // {_PER_PAGE} AS BIGINT) AS part, s_suppkey, CASE WHEN s_acctbal < 0 THEN 'owing' ELSE 'paid' END AS grp, s_name AS name, n_name AS nation, CAST(s_acctbal >= 5000 AS INTEGER) AS credit, CAST(s_suppkey % 3 = 0 AS INTEGER) AS express
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def html_table_rows(t):
    """Pages of suppliers by nation, written as a table with a two-row header, group headings, a nation that spans all rows of its group and ticks; read back as rows."""
    cell = lambda *x: F.concat(F.lit("<td>"), *x, F.lit("</td>"))
    tick = lambda c: cell(F.when(c, F.lit("✓")).otherwise(F.lit("")))
    rows = t.supplier.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey")).withColumns({"part": F.floor(F.col("s_suppkey") / _PER_PAGE), "grp": F.when(F.col("s_acctbal") < 0, "owing").otherwise("paid")})
    line = F.concat(cell(F.col("s_suppkey").cast("string")), cell(F.lit("<b>"), "s_name", F.lit("</b><br>")), F.lit("@"), tick(F.col("s_acctbal") >= 5000), tick(F.col("s_suppkey") % 3 == 0))
    groups = rows.groupBy("s_nationkey", "n_name", "part", "grp").agg(F.sort_array(F.collect_list(F.struct("s_suppkey", line.alias("line")))).alias("lines"))
    nation = F.concat(F.lit('<td rowspan="'), F.size("lines").cast("string"), F.lit('">'), "n_name", F.lit("</td>"))
    body = F.array_join(F.transform("lines", lambda x, i: F.concat(F.lit("<tr>"), F.replace(x["line"], F.lit("@"), F.when(i == 0, nation).otherwise(F.lit(""))))), "")
    groups = groups.select("s_nationkey", "part", F.concat(F.lit("<tr><td colspan=5>Group: "), "grp", F.lit("</td></tr>"), body).alias("body"))
    head = "<table><tr><td>menu</td></tr></table><table class=list><tr><th rowspan=2>Key<th rowspan=2>Supplier<th rowspan=2>Nation<th colspan=2>Terms<tr><th>credit<th>express"
    pages = groups.groupBy("s_nationkey", "part").agg(F.concat(F.lit(head), F.array_join(F.sort_array(F.collect_list("body")), ""), F.lit("</table>")).alias("html"))
    read = _stage(lambda h: [[r[c] for c in ("Key", "group", "Supplier", "Nation", "Terms credit", "Terms express")] for r in html.table_rows(h, ("supplier", "terms"), r"^Group: (\w+)$")], "array<array<string>>")
    got = pages.select("s_nationkey", "part", F.explode(read("html")).alias("r"))
    at = lambda i: F.col("r")[i]
    return got.select("s_nationkey", "part", at(0).cast("long").alias("s_suppkey"), at(1).alias("grp"), at(2).alias("name"), at(3).alias("nation"), (at(4) == "x").cast("int").alias("credit"), (at(5) == "x").cast("int").alias("express"))


@query("html_sections", """SELECT p_partkey, p_brand AS brand, CAST(p_size AS VARCHAR) AS size, 'About' AS title, 'The ' || p_name || ' is of type ' || p_type || '.' || chr(10) || chr(10) || '- ' || p_brand || chr(10) || '- size ' || p_size AS body FROM part
UNION ALL SELECT p_partkey, p_brand, CAST(p_size AS VARCHAR), 'Prices', 'from ' || CAST(p_partkey % 1000 AS VARCHAR) FROM part WHERE p_partkey % 2 = 0""")
def html_sections(t):
    """A page of labelled facts and titled sections for each part: facts by a label map, sections without those to be skipped and without noise."""
    s = lambda c: F.col(c).cast("string")
    page = F.concat(F.lit("<nav><p>Brand: none</p></nav><div class=overview><ul><li>BRAND : "), "p_brand", F.lit("</li><li>Size: <b>"), s("p_size"), F.lit("</b><li>Colour: any</ul></div><section><h2 class=sec-title>About</h2><div class=sec-con><p>The "), "p_name", F.lit(" is of type <i>"), "p_type", F.lit(".</i><p>see more</p><ul><li>"), "p_brand", F.lit("<li>size "), s("p_size"), F.lit("</ul></div><p>outside</p></section><section><h2 class=sec-title>Related</h2><p>skipped</p></section>"),
                    F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("<section><h4 class='sec-title x'>Prices</h4><strong>from "), (F.col("p_partkey") % 1000).cast("string"), F.lit("</strong></section>"))).otherwise(F.lit("<section><h4 class=sec-title>Prices</h4></section>")))
    labels = {"brand": "brand", "size": "size"}
    read = _stage(lambda h: [[f.get("brand"), f.get("size"), *x] for page in [html.tree(h)] for f in [html.facts(page, labels)] for x in html.sections(page, frozenset({"related"}), frozenset({"see more"}), "sec-title", "sec-con")], "array<array<string>>")
    got = t.part.select("p_partkey", F.explode(read(page)).alias("r"))
    return got.select("p_partkey", *[F.col("r")[i].alias(c) for i, c in enumerate(("brand", "size", "title", "body"))])


# Sentences
def aliases(t):
    """The dictionary: names of parts, codes of brands, nations and suppliers, and abbreviations of part types."""
    row = lambda df, c, kind, what: df.select(F.col(c).alias("alias"), F.lit(kind).alias("kind"), F.lit(what).alias("entity_type")).distinct()
    out = row(t.part, "p_name", "name", "part").unionByName(row(t.part, "p_brand", "code", "brand")).unionByName(row(t.nation, "n_name", "code", "nation"))
    return out.unionByName(row(t.supplier, "s_name", "code", "supplier")).unionByName(row(t.part, "p_type", "abbrev", "type"))


@query("scan_sentences")
def scan_documents(t):
    """The dictionary's entries in every whole document."""
    return scan_sentences(t.documents, aliases(t), "doc_id", "text", written=True)


_REQUEST = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_name, p_brand, p_type, s_name, n_name, CAST(year(l_shipdate) AS VARCHAR) AS y"


@query("scan_requests", f"""WITH r AS ({_REQUEST}, row_number() OVER () AS k FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey),
c AS (SELECT *, 'Señd ' AS a, upper(replace(p_name, ' ', ' - ')) AS part, ' (' AS b, upper(p_brand) AS brand, ', ' AS c, p_type AS type, ') by ' AS d, s_name AS supplier, ' / ' AS e, lower(n_name) AS nation, ', not ' || p_brand || 'x or ' || lower(p_type) || ', in ' AS f FROM r),
o AS (SELECT *, length(a) AS p1, length(a || part || b) AS p2, length(a || part || b || brand || c) AS p3, length(a || part || b || brand || c || type || d) AS p4, length(a || part || b || brand || c || type || d || supplier || e) AS p5 FROM c)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, [p1 || ':' || (p1 + length(part)) || ':part:' || part, p2 || ':' || (p2 + length(brand)) || ':brand:' || brand, p3 || ':' || (p3 + length(type)) || ':type:' || type, p4 || ':' || (p4 + length(supplier)) || ':supplier:' || supplier, p5 || ':' || (p5 + length(nation)) || ':nation:' || nation] AS mentions,
  CASE WHEN y >= '2000' THEN [CAST(y AS INTEGER)] ELSE [] END AS years FROM o""")
def scan_requests(t):
    """A sentence for each order line, with its part, brand, type, supplier and nation in other letter cases, among words that are nearly entries."""
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.year("l_shipdate").alias("y"))
    lines = lines.join(t.part, F.col("p_partkey") == F.col("l_partkey")).join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).join(F.broadcast(t.nation), F.col("n_nationkey") == F.col("s_nationkey"))
    sentence = F.concat(F.lit("Señd "), F.upper(F.replace("p_name", F.lit(" "), F.lit(" - "))), F.lit(" ("), F.upper("p_brand"), F.lit(", "), "p_type", F.lit(") by "), "s_name", F.lit(" / "), F.lower("n_name"), F.lit(", not "), "p_brand", F.lit("x or "), F.lower("p_type"), F.lit(", in "), F.col("y").cast("string"))
    keyed = lines.select(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("line"), sentence.alias("text"))
    return scan_sentences(keyed, aliases(t), "line", "text", written=True).select("line.*", "mentions", "years")
