"""The scores and list tools over requests that tables hold: up to three entities, years and methods, differences between years and between
entities, filters by region, segment and missing method, ranks with ties and statistics before the limit."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.operators.tools import envelope, plain
from tessella.plans import query
from tessella.plans.tools import _ANSWER, _METHODS, _NORM, _requests, _values

#: Entities, years and methods of a request, at most.
MOST = 3
_FACT = "SELECT c_nationkey AS code, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS method, max(CAST(o_totalprice AS DECIMAL(15,2))) AS best, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > {0} GROUP BY ALL"


def facts(t, over: int):
    """code, year, method, best, n of the orders over a price."""
    orders = t.orders.where(F.col("o_totalprice") > over).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    by = (F.col("c_nationkey").alias("code"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("method"))
    return orders.groupBy(*by).agg(F.max(F.col("o_totalprice").cast("decimal(15,2)")).alias("best"), F.count("*").alias("n"))


def _years(req, fact):
    """req, year, covered: the years asked for, or the last one with data."""
    known = fact.select("year").distinct().withColumn("covered", F.lit(True))
    latest = fact.agg(F.max("year").alias("latest"))
    asked = req.crossJoin(F.broadcast(latest)).select("req", F.explode(F.when(F.size("years") == 0, F.array("latest")).otherwise(F.array_distinct("years"))).alias("year"))
    return asked.join(known, "year", "left").select("req", "year", F.coalesce("covered", F.lit(False)).alias("covered"))


def _labels(req, methods):
    """req, label, child: each method asked for with the methods that it stands for (itself, or its children); a request without any has them all under ''."""
    named = req.where(F.size("methods") > 0).select("req", F.explode(F.array_distinct("methods")).alias("label"))
    stands = methods.select(F.col("child").alias("label"), "child").unionByName(methods.where("parent IS NOT NULL").select(F.col("parent").alias("label"), "child"))
    every = req.where(F.size("methods") == 0).select("req", F.lit("").alias("label")).crossJoin(F.broadcast(methods.select("child")))
    return named.join(stands, "label").select("req", "label", "child").unionByName(every), named.join(stands, "label", "left_anti")


_SCORES_SQL = f"""
WITH req AS (SELECT c_custkey AS req, list_distinct(list_transform(CASE c_custkey % 4 WHEN 0 THEN [c_nationkey] WHEN 1 THEN [c_nationkey, (c_nationkey + 1) % 25] WHEN 2 THEN [c_nationkey, (c_nationkey + 7) % 25, (c_nationkey + 1) % 25] ELSE CASE WHEN c_custkey % 8 = 3 THEN [c_nationkey, 99] ELSE [c_nationkey, (c_nationkey + 1) % 25, (c_nationkey + 2) % 25, (c_nationkey + 3) % 25] END END, lambda k: CASE WHEN c_custkey % 2 = 0 THEN 'Nation ' ELSE 'NATION_' END || k)) AS entities0,
  CASE c_custkey % 4 WHEN 0 THEN [c_nationkey] WHEN 1 THEN [c_nationkey, (c_nationkey + 1) % 25] WHEN 2 THEN [c_nationkey, (c_nationkey + 7) % 25, (c_nationkey + 1) % 25] ELSE CASE WHEN c_custkey % 8 = 3 THEN [c_nationkey, 99] ELSE [c_nationkey, (c_nationkey + 1) % 25, (c_nationkey + 2) % 25, (c_nationkey + 3) % 25] END END AS keys, CASE WHEN c_custkey % 2 = 0 THEN 'Nation ' ELSE 'NATION_' END AS prefix,
  CASE c_custkey % 5 WHEN 0 THEN [] WHEN 1 THEN [1996] WHEN 2 THEN [1997, 1995] WHEN 3 THEN [1950, 1998] ELSE [1995, 1996, 1997, 1998] END AS years, CASE c_custkey % 3 WHEN 0 THEN [] WHEN 1 THEN ['HIGH'] ELSE ['5-LOW', '9-NEVER'] END AS methods FROM customer),
good AS (SELECT * FROM req WHERE len(keys) <= 3 AND len(years) <= 3), m(child, parent) AS {_values(_METHODS)}, fact AS ({_FACT.format(250000)}),
ent AS (SELECT req, unnest(keys) AS code, unnest(range(len(keys))) AS pos, prefix FROM good),
yr AS (SELECT req, unnest(CASE WHEN len(years) = 0 THEN [(SELECT max(year) FROM fact)] ELSE years END) AS year FROM good),
lab AS (SELECT req, unnest(CASE WHEN len(methods) = 0 THEN [''] ELSE methods END) AS label FROM good),
kids AS (SELECT l.req, l.label, m.child FROM lab l JOIN m ON l.label IN ('', m.child) OR l.label = m.parent),
shown AS (SELECT DISTINCT e.req, e.pos, f.code, f.year, f.method, f.n, f.best FROM ent e JOIN yr y USING (req) JOIN kids k USING (req) JOIN fact f ON f.code = e.code AND f.year = y.year AND f.method = k.child),
data AS (SELECT req, concat_ws('|', 'row', code, year, method, n, best) AS row, 'orders ' || year AS source FROM shown
  UNION ALL SELECT req, concat_ws('|', 'years', code, method, y0, year, best - b0), 'orders ' || year FROM (SELECT *, lag(year) OVER w AS y0, lag(best) OVER w AS b0 FROM shown WINDOW w AS (PARTITION BY req, code, method ORDER BY year)) WHERE y0 IS NOT NULL
  UNION ALL SELECT a.req, concat_ws('|', 'entities', a.year, a.method, a.code, b.code, b.best - a.best), 'orders ' || a.year FROM shown a JOIN shown b ON a.req = b.req AND a.year = b.year AND a.method = b.method AND a.pos < b.pos),
missing AS (SELECT req, prefix || code AS item, 'unknown' AS reason FROM ent WHERE code = 99 UNION ALL SELECT req, label, 'unknown method' FROM lab WHERE label = '9-NEVER' UNION ALL SELECT req, CAST(year AS VARCHAR), 'year not covered' FROM yr WHERE year NOT IN (SELECT year FROM fact)
  UNION ALL SELECT DISTINCT e.req, concat_ws(' ', e.code, y.year, nullif(k.label, '')), CASE WHEN k.label <> '' AND NOT EXISTS (SELECT 1 FROM fact f JOIN kids x ON x.req = e.req AND x.label = k.label AND x.child = f.method WHERE f.year = y.year) THEN 'method without year' ELSE 'no row' END
    FROM ent e JOIN yr y USING (req) JOIN kids k USING (req) WHERE e.code <> 99 AND y.year IN (SELECT year FROM fact) AND NOT EXISTS (SELECT 1 FROM shown s JOIN kids x ON x.req = s.req AND x.child = s.method WHERE s.req = e.req AND s.code = e.code AND s.year = y.year AND x.label = k.label)
  UNION ALL SELECT req, 'input', 'more than 3 entities' FROM req WHERE len(keys) > 3 UNION ALL SELECT req, 'input', 'more than 3 years' FROM req WHERE len(years) > 3),
clarify AS (SELECT 0 AS req, '' AS candidate WHERE false)
{_ANSWER}"""


@query("tool_scores_requests", _SCORES_SQL)
def tool_scores_requests(t):
    """A request for each customer: scores of up to three nations, years and methods, differences between an entity's years asked for and between
    the entities of a year and method, in the order in which they are asked for. More of anything is refused; what is missing is said by entity, year and method."""
    c, n = F.col("c_custkey"), F.col("c_nationkey")
    keys = F.when(c % 4 == 0, F.array(n)).when(c % 4 == 1, F.array(n, (n + 1) % 25)).when(c % 4 == 2, F.array(n, (n + 7) % 25, (n + 1) % 25)).when(c % 8 == 3, F.array(n, F.lit(99))).otherwise(F.array(n, (n + 1) % 25, (n + 2) % 25, (n + 3) % 25))
    years = F.when(c % 5 == 0, F.array().cast("array<int>")).when(c % 5 == 1, F.array(F.lit(1996))).when(c % 5 == 2, F.array(F.lit(1997), F.lit(1995))).when(c % 5 == 3, F.array(F.lit(1950), F.lit(1998))).otherwise(F.array(*map(F.lit, range(1995, 1999))))
    methods = F.when(c % 3 == 0, F.array().cast("array<string>")).when(c % 3 == 1, F.array(F.lit("HIGH"))).otherwise(F.array(F.lit("5-LOW"), F.lit("9-NEVER")))
    entities = F.transform(keys, lambda k: F.concat(F.when(c % 2 == 0, "Nation ").otherwise("NATION_"), k.cast("string")))
    return scores(t.customer.select(c.alias("req"), entities.alias("entities"), years.alias("years"), methods.alias("methods")), t.nation.selectExpr("n_nationkey AS code", "n_name AS name"), _requests(t, "child string, parent string", _METHODS), facts(t, 250000))


def scores(req, catalog, methods, fact):
    """The envelope of requests (req, entities, years, methods) over a catalog (code, name), methods (child, parent) and facts (code, year, method, best, n)."""
    over = F.array_compact(F.array(*[F.when(F.size(F.array_distinct(k)) > MOST, F.lit(f"more than {MOST} {k}")) for k in ("entities", "years", "methods")]))
    refused = req.select("req", F.lit("input").alias("item"), F.explode(over).alias("reason"))
    good = req.where(F.size(over) == 0)
    named = good.select("req", F.posexplode(F.array_distinct("entities")).alias("pos", "mention")).withColumn("k", plain(F.col("mention")))
    names = catalog.select("code", plain(F.col("name")).alias("k"))
    entity = named.join(names, "k").select("req", "pos", "code")
    unknown = named.join(names, "k", "left_anti").select("req", F.col("mention").alias("item"), F.lit("unknown").alias("reason"))
    year, (label, strange) = _years(good, fact), _labels(good, methods)
    grid = entity.join(year.where("covered"), "req").join(label, "req")
    met = grid.join(fact.withColumnRenamed("method", "child"), ["code", "year", "child"], "left")
    shown = met.where("n IS NOT NULL").select("req", "pos", "code", "year", "child", "n", "best").distinct()
    source = F.concat(F.lit("orders "), "year").alias("source")
    before = Window.partitionBy("req", "code", "child").orderBy("year")
    between = shown.withColumns({"y0": F.lag("year").over(before), "b0": F.lag("best").over(before)}).where("y0 IS NOT NULL")
    later = shown.select("req", "year", "child", F.col("pos").alias("pos_b"), F.col("code").alias("b"), F.col("best").alias("best_b"))  # three entities at most
    pairs = shown.join(later, ["req", "year", "child"]).where("pos < pos_b")
    row = lambda df, *x: df.select("req", F.concat_ws("|", *x).alias("row"), source)
    data = row(shown, F.lit("row"), "code", "year", "child", "n", "best").unionByName(row(between, F.lit("years"), "code", "child", "y0", "year", F.col("best") - F.col("b0"))).unionByName(row(pairs, F.lit("entities"), "year", "child", "code", "b", F.col("best_b") - F.col("best")))
    offered = fact.select(F.col("method").alias("child"), "year", F.lit(1).alias("offered")).distinct()
    lost = met.join(offered, ["child", "year"], "left").groupBy("req", "code", "year", "label").agg(F.count("n").alias("rows"), F.count("offered").alias("offered")).where("rows = 0")
    lost = lost.select("req", F.concat_ws(" ", "code", "year", F.nullif("label", F.lit(""))).alias("item"), F.when((F.col("label") != "") & (F.col("offered") == 0), "method without year").otherwise("no row").alias("reason"))
    late = year.where("NOT covered").select("req", F.col("year").cast("string").alias("item"), F.lit("year not covered").alias("reason"))
    odd = strange.select("req", F.col("label").alias("item"), F.lit("unknown method").alias("reason"))
    none = req.where("false").select("req", F.lit("").alias("candidate"))
    return envelope(req, data, unknown.unionByName(odd).unionByName(late).unionByName(lost).unionByName(refused), none)


_LISTS_SQL = f"""
WITH req AS (SELECT s_suppkey AS req, CASE WHEN s_suppkey % 24 = 23 THEN 'NOWHERE' WHEN s_suppkey % 6 < 5 THEN r_name END AS region, CASE WHEN s_suppkey % 2 = 0 THEN 'score' ELSE 'quota' END AS metric, s_suppkey % 3 = 0 AS rising,
  CASE s_suppkey % 4 WHEN 0 THEN [] WHEN 1 THEN [1996, 1997] WHEN 2 THEN [1997, 1995, 1996] ELSE [1997, 1950] END AS years, CASE s_suppkey % 5 WHEN 1 THEN '1-URGENT' WHEN 2 THEN 'HIGH' WHEN 3 THEN '5-LOW' WHEN 4 THEN '3-MEDIUM' END AS method,
  CASE WHEN s_suppkey % 7 = 1 THEN '1-URGENT' END AS without, CASE WHEN s_suppkey % 7 = 2 THEN 'BUILDING' END AS segment, CASE WHEN s_suppkey % 11 = 4 THEN 470000 END AS least, CASE WHEN s_suppkey % 50 = 49 THEN 0 WHEN s_suppkey % 9 <> 0 THEN 1 + s_suppkey % 4 END AS lim
  FROM supplier JOIN region ON r_regionkey = s_suppkey % 5),
m(child, parent) AS {_values(_METHODS)}, fact AS ({_FACT.format(450000)}), segments AS (SELECT DISTINCT c_nationkey AS code, CAST(year(o_orderdate) AS INTEGER) AS year, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 450000),
good AS (SELECT q.*, r_regionkey AS code FROM req q LEFT JOIN region ON r_name = q.region WHERE coalesce(lim, 1) BETWEEN 1 AND 100 AND (q.region IS NULL OR r_regionkey IS NOT NULL)),
yr AS (SELECT req, unnest(CASE WHEN len(years) = 0 THEN [(SELECT max(year) FROM fact)] ELSE years END) AS year FROM good),
per AS (SELECT 'score' AS metric, code, year, method, best AS value FROM fact UNION ALL SELECT 'quota', code, year, '', CAST(sum(n) AS DECIMAL(15,2)) FROM fact GROUP BY code, year),
fits AS (SELECT g.req, g.lim, g.metric, g.rising, p.code, n_name AS name, p.year, p.method, p.value FROM good g JOIN yr y USING (req) JOIN per p ON p.metric = g.metric AND p.year = y.year JOIN nation ON n_nationkey = p.code
  WHERE (g.code IS NULL OR n_regionkey = g.code) AND (g.metric = 'quota' OR g.method IS NULL OR p.method IN (SELECT child FROM m WHERE child = g.method OR parent = g.method))
    AND (g.without IS NULL OR NOT EXISTS (SELECT 1 FROM fact f WHERE f.code = p.code AND f.year = p.year AND f.method = g.without)) AND (g.segment IS NULL OR EXISTS (SELECT 1 FROM segments s WHERE s.code = p.code AND s.year = p.year AND s.segment = g.segment))
    AND (g.metric = 'quota' OR g.least IS NULL OR p.value >= g.least)),
ranked AS (SELECT *, CASE WHEN rising THEN rank() OVER (PARTITION BY req, year, method ORDER BY value) ELSE rank() OVER (PARTITION BY req, year, method ORDER BY value DESC) END AS rnk FROM fits),
shown AS (SELECT * FROM ranked WHERE lim IS NULL OR rnk <= lim),
data AS (SELECT req, concat_ws('|', 'row', year, method, rnk, name, value) AS row, 'orders ' || year AS source FROM shown
  UNION ALL SELECT req, concat_ws('|', 'stats', year, method, count(*), min(value), max(value), CASE WHEN metric = 'quota' THEN CAST(sum(value) AS DECIMAL(15,2)) END, CASE WHEN any_value(lim) IS NOT NULL AND max(rnk) > any_value(lim) THEN 'truncated' ELSE 'whole' END), 'orders ' || year FROM ranked GROUP BY req, year, method, metric
  UNION ALL SELECT req, concat_ws('|', 'years', name, method, y0, year, value - v0), 'orders ' || year FROM (SELECT *, lag(year) OVER w AS y0, lag(value) OVER w AS v0 FROM shown WINDOW w AS (PARTITION BY req, name, method ORDER BY year)) WHERE y0 IS NOT NULL),
missing AS (SELECT req, region AS item, 'unknown' AS reason FROM req WHERE region = 'NOWHERE' AND coalesce(lim, 1) BETWEEN 1 AND 100 UNION ALL SELECT req, CAST(year AS VARCHAR), 'year not covered' FROM yr WHERE year NOT IN (SELECT year FROM fact)
  UNION ALL SELECT req, 'quota by ' || method, 'not collected' FROM good WHERE metric = 'quota' AND method IS NOT NULL UNION ALL SELECT req, 'input', 'limit out of 1 to 100' FROM req WHERE lim = 0),
clarify AS (SELECT 0 AS req, '' AS candidate WHERE false)
{_ANSWER}"""


@query("tool_list_requests", _LISTS_SQL)
def tool_list_requests(t):
    """A request for each supplier: nations of a region (or all) by score or quota, rising or falling, of up to three years, with filters by method, a method
    that they lack, a segment that they have and a least score; ranks with ties up to a limit, statistics of all rows before it, differences between the years of the rows shown."""
    s = F.col("s_suppkey")
    years = F.when(s % 4 == 0, F.array().cast("array<int>")).when(s % 4 == 1, F.array(F.lit(1996), F.lit(1997))).when(s % 4 == 2, F.array(F.lit(1997), F.lit(1995), F.lit(1996))).otherwise(F.array(F.lit(1997), F.lit(1950)))
    method = F.when(s % 5 == 1, "1-URGENT").when(s % 5 == 2, "HIGH").when(s % 5 == 3, "5-LOW").when(s % 5 == 4, "3-MEDIUM")
    named = t.supplier.join(F.broadcast(t.region), F.col("r_regionkey") == s % 5)
    req = named.select(s.alias("req"), F.when(s % 24 == 23, "NOWHERE").when(s % 6 < 5, F.col("r_name")).alias("region"), F.when(s % 2 == 0, "score").otherwise("quota").alias("metric"), (s % 3 == 0).alias("rising"), years.alias("years"), method.alias("method"),
                       F.when(s % 7 == 1, "1-URGENT").alias("without"), F.when(s % 7 == 2, "BUILDING").alias("segment"), F.when(s % 11 == 4, 470000).alias("least"), F.when(s % 50 == 49, 0).when(s % 9 != 0, s % 4 + 1).alias("lim"))
    fact = facts(t, 450000)
    orders = t.orders.where("o_totalprice > 450000").join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    segments = orders.select(F.col("c_nationkey").alias("code"), F.year("o_orderdate").alias("year"), F.col("c_mktsegment").alias("segment")).distinct()
    return lists(req, t.region.selectExpr("r_regionkey AS unit", "r_name AS region"), t.nation.selectExpr("n_nationkey AS code", "n_name AS name", "n_regionkey AS unit"), _requests(t, "child string, parent string", _METHODS), fact, segments)


def lists(req, units, catalog, methods, fact, segments):
    """The envelope of list requests (req, region, metric, rising, years, method, without, segment, least, lim)."""
    fine = F.coalesce(F.col("lim"), F.lit(1)).between(1, 100)
    bad = req.where(~fine).select("req", F.lit("input").alias("item"), F.lit("limit out of 1 to 100").alias("reason"))
    placed = req.where(fine).join(F.broadcast(units), "region", "left")
    unknown = placed.where("region IS NOT NULL AND unit IS NULL").select("req", F.col("region").alias("item"), F.lit("unknown").alias("reason"))
    good = placed.where("region IS NULL OR unit IS NOT NULL")
    year = _years(good, fact)
    scored = fact.select(F.lit("score").alias("metric"), "code", "year", F.col("method").alias("of"), F.col("best").alias("value"))
    counted = fact.groupBy("code", "year").agg(F.sum("n").cast("decimal(15,2)").alias("value")).select(F.lit("quota").alias("metric"), "code", "year", F.lit("").alias("of"), "value")
    per = scored.unionByName(counted).join(F.broadcast(catalog), "code")
    asked = good.drop("years").join(year.where("covered"), "req")
    kids = methods.select(F.col("child").alias("method"), F.col("child").alias("of")).unionByName(methods.where("parent IS NOT NULL").select(F.col("parent").alias("method"), F.col("child").alias("of")))
    one = asked.where("metric = 'score' AND method IS NOT NULL").join(kids, "method")
    whole = asked.where("metric = 'quota' OR method IS NULL")
    columns = ["req", "lim", "metric", "rising", "unit", "without", "segment", "least", "year"]
    met = whole.select(*columns).join(per.withColumnRenamed("unit", "home"), ["metric", "year"]).unionByName(one.select(*columns, "of").join(per.withColumnRenamed("unit", "home"), ["metric", "year", "of"]).select(*["metric", "year", *[c for c in columns if c not in ("metric", "year")], "code", "of", "value", "name", "home"]))
    met = met.where("(unit IS NULL OR unit = home) AND (metric = 'quota' OR least IS NULL OR value >= least)")
    met = met.join(fact.select("code", "year", F.col("method").alias("without")), ["code", "year", "without"], "left_anti")
    met = met.join(segments.withColumn("there", F.lit(True)), ["code", "year", "segment"], "left").where("segment IS NULL OR there")
    by = Window.partitionBy("req", "year", "of")
    ranked = met.withColumn("rnk", F.rank().over(by.orderBy(F.when(F.col("rising"), F.col("value")).otherwise(-F.col("value")))))
    shown = ranked.where("lim IS NULL OR rnk <= lim")
    source = F.concat(F.lit("orders "), "year").alias("source")
    row = lambda df, *x: df.select("req", F.concat_ws("|", *x).alias("row"), source)
    stats = ranked.groupBy("req", "year", "of", "metric").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.sum("value").cast("decimal(15,2)").alias("sum"), F.max(F.coalesce(F.col("rnk") > F.col("lim"), F.lit(False))).alias("cut"))
    before = Window.partitionBy("req", "name", "of").orderBy("year")
    between = shown.withColumns({"y0": F.lag("year").over(before), "v0": F.lag("value").over(before)}).where("y0 IS NOT NULL")
    data = row(shown, F.lit("row"), "year", "of", "rnk", "name", "value").unionByName(row(stats, F.lit("stats"), "year", "of", "n", "low", "high", F.when(F.col("metric") == "quota", F.col("sum")), F.when(F.col("cut"), "truncated").otherwise("whole"))).unionByName(row(between, F.lit("years"), "name", "of", "y0", "year", F.col("value") - F.col("v0")))
    late = year.where("NOT covered").select("req", F.col("year").cast("string").alias("item"), F.lit("year not covered").alias("reason"))
    odd = good.where("metric = 'quota' AND method IS NOT NULL").select("req", F.concat(F.lit("quota by "), "method").alias("item"), F.lit("not collected").alias("reason"))
    return envelope(req, data, unknown.unionByName(bad).unionByName(late).unionByName(odd), req.where("false").select("req", F.lit("").alias("candidate")))


# ---------------------------------------------------------------- fees: four kinds, each with years of its own
_KINDS = ("program", "year_rule", "credit", "fee")
_ALL_KINDS_SQL = "[" + ", ".join(f"'{k}'" for k in _KINDS) + "]"
_MONEY = "DECIMAL(15,2)"
_FEES_SQL = f"""
WITH req AS (SELECT s_suppkey AS req, 'nation ' || CASE WHEN s_suppkey % 11 = 10 THEN 99 ELSE s_nationkey END AS mention, CASE s_suppkey % 6 WHEN 0 THEN {_ALL_KINDS_SQL} WHEN 1 THEN ['program'] WHEN 2 THEN ['year_rule'] WHEN 3 THEN ['credit', 'fee', 'colour'] WHEN 4 THEN ['fee'] ELSE ['colour'] END AS kinds,
  CASE s_suppkey % 4 WHEN 1 THEN 1996 WHEN 2 THEN 1950 WHEN 3 THEN 1999 END AS year FROM supplier),
paid AS (SELECT c_nationkey AS code, n_regionkey AS region, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(o_totalprice AS {_MONEY}) AS amount FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey),
general AS (SELECT region, year, min(amount) AS amount FROM paid GROUP BY ALL),
fact AS (SELECT 'program' AS kind, code, year, concat_ws('|', 'program', year, min(amount), max(amount), 'per order') AS row, 'orders' AS source FROM paid GROUP BY code, year
  UNION ALL SELECT 'year_rule', code, year, concat_ws('|', 'year_rule', year, 'flat', min(amount), 'per year'), 'orders' FROM paid WHERE code % 5 = 0 GROUP BY code, year
  UNION ALL SELECT 'year_rule', n_nationkey, year, concat_ws('|', 'year_rule', year, 'general', amount, 'per year'), 'orders' FROM general JOIN nation ON n_regionkey = region WHERE NOT EXISTS (SELECT 1 FROM paid p WHERE p.code = n_nationkey AND p.year = general.year AND p.code % 5 = 0)
  UNION ALL SELECT 'credit', code, year, concat_ws('|', 'credit', year, max(amount), 'per unit'), 'lineitem' FROM (SELECT s_nationkey AS code, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(l_extendedprice AS {_MONEY}) AS amount FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity = 1) GROUP BY code, year
  UNION ALL SELECT 'fee', -1, year, concat_ws('|', 'fee', year, l_linestatus, max(amount), 'once'), 'lineitem' FROM (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, l_linestatus, CAST(l_tax AS {_MONEY}) AS amount FROM lineitem) GROUP BY year, l_linestatus),
found AS (SELECT req, n_nationkey AS code, kinds, year FROM req JOIN nation ON mention = {_NORM("n_name")}),
asked AS (SELECT req, code, kind, coalesce(a.year, (SELECT max(year) FROM fact f WHERE f.kind = a.kind)) AS year FROM (SELECT req, code, year, unnest(kinds) AS kind FROM found) a),
data AS (SELECT req, row, source FROM asked a JOIN fact f ON a.kind = f.kind AND a.year = f.year AND f.code = CASE WHEN a.kind = 'fee' THEN -1 ELSE a.code END),
missing AS (SELECT req, mention AS item, 'unknown' AS reason FROM req WHERE req NOT IN (SELECT req FROM found) UNION ALL SELECT req, kind, 'no such kind' FROM asked WHERE kind NOT IN (SELECT unnest({_ALL_KINDS_SQL}))
  UNION ALL SELECT req, kind || ' ' || year, CASE WHEN EXISTS (SELECT 1 FROM fact f WHERE f.kind = a.kind AND f.year = a.year) THEN 'no row' ELSE 'year not collected' END FROM asked a
    WHERE year IS NOT NULL AND kind IN (SELECT unnest({_ALL_KINDS_SQL})) AND NOT EXISTS (SELECT 1 FROM fact f WHERE f.kind = a.kind AND f.year = a.year AND f.code = CASE WHEN a.kind = 'fee' THEN -1 ELSE a.code END)),
clarify AS (SELECT 0 AS req, '' AS candidate WHERE false)
{_ANSWER}"""


@query("tool_fees_requests", _FEES_SQL)
def tool_fees_requests(t):
    """Fees of four kinds, a request a supplier: amounts of an entity, rules of a year (a flat one suppresses the general one of the region),
    rates a unit, and fees that hold for all. A kind has years of its own: its last one counts where none is asked for, and one that it
    lacks is missing for it alone. Amounts keep their unit; none is turned into another kind's."""
    k = F.col("s_suppkey")
    kinds = F.when(k % 6 == 0, F.array(*map(F.lit, _KINDS))).when(k % 6 == 1, F.array(F.lit("program"))).when(k % 6 == 2, F.array(F.lit("year_rule"))).when(k % 6 == 3, F.array(F.lit("credit"), F.lit("fee"), F.lit("colour"))).when(k % 6 == 4, F.array(F.lit("fee"))).otherwise(F.array(F.lit("colour")))
    entity = F.when(k % 11 == 10, 99).otherwise(F.col("s_nationkey"))
    req = t.supplier.select(k.alias("req"), F.concat(F.lit("nation "), entity.cast("string")).alias("mention"), kinds.alias("kinds"), F.when(k % 4 == 1, 1996).when(k % 4 == 2, 1950).when(k % 4 == 3, 1999).alias("year"))
    place = t.nation.select(F.col("n_nationkey").alias("code"), F.col("n_regionkey").alias("region"), plain(F.col("n_name")).alias("mention"))
    money = lambda c: F.col(c).cast("decimal(15,2)")
    paid = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("code"), F.year("o_orderdate").alias("year")).agg(F.min(money("o_totalprice")).alias("low"), F.max(money("o_totalprice")).alias("high"))
    fact = lambda df, kind, source, *parts: df.select(F.lit(kind).alias("kind"), "code", "year", F.concat_ws("|", F.lit(kind), *parts).alias("row"), F.lit(source).alias("source"))
    # Amounts by entity and year, at most: the regions' rules come from these, not from the orders again.
    flat = paid.where("code % 5 = 0")
    general = paid.join(place, "code").groupBy("region", "year").agg(F.min("low").alias("low")).join(place.select("region", "code"), "region").join(flat.select("code", "year"), ["code", "year"], "left_anti")
    credit = t.lineitem.where("l_quantity = 1").join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("s_nationkey").alias("code"), F.year("l_shipdate").alias("year")).agg(F.max(money("l_extendedprice")).alias("high"))
    once = t.lineitem.groupBy(F.year("l_shipdate").alias("year"), "l_linestatus").agg(F.max(money("l_tax")).alias("high")).withColumn("code", F.lit(-1))
    facts = fact(paid, "program", "orders", "year", "low", "high", F.lit("per order")).unionByName(fact(flat, "year_rule", "orders", "year", F.lit("flat"), "low", F.lit("per year")))
    facts = facts.unionByName(fact(general, "year_rule", "orders", "year", F.lit("general"), "low", F.lit("per year"))).unionByName(fact(credit, "credit", "lineitem", "year", "high", F.lit("per unit"))).unionByName(fact(once, "fee", "lineitem", "year", "l_linestatus", "high", F.lit("once")))
    years = facts.groupBy("kind").agg(F.collect_set("year").alias("years"))
    found = req.join(place, "mention").select("req", "code", "year", F.explode("kinds").alias("kind")).join(years, "kind", "left")
    asked = found.select("req", "kind", "years", F.coalesce("year", F.array_max("years")).alias("year"), F.when(F.col("kind") == "fee", -1).otherwise(F.col("code")).alias("code"))
    both = asked.join(facts, ["kind", "year", "code"], "left")
    strange = asked.where(~F.col("kind").isin(*_KINDS)).select("req", F.col("kind").alias("item"), F.lit("no such kind").alias("reason"))
    lacking = both.where(F.col("row").isNull() & F.col("kind").isin(*_KINDS) & F.col("year").isNotNull()).select("req", F.concat_ws(" ", "kind", "year").alias("item"), F.when(F.array_contains("years", F.col("year")), "no row").otherwise("year not collected").alias("reason"))
    unknown = req.join(place, "mention", "left_anti").select("req", F.col("mention").alias("item"), F.lit("unknown").alias("reason"))
    return envelope(req, both.where("row IS NOT NULL").select("req", "row", "source"), unknown.unionByName(strange).unionByName(lacking), req.where("false").select("req", F.lit("").alias("candidate")))
