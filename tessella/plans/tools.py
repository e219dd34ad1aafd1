"""The six relational tools over the driver's tables: nations for entities, orders by priority for scores, parts for programmes.

Each answers all its requests at once and returns the envelope of operators.tools. The SQL beside it is written from the tools'
statement, in correlated subqueries, and shares no text with the DataFrame code.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.operators.intervals import join_overlaps
from tessella.operators.tools import envelope, invalid, plain, resolved
from tessella.plans import query

_NORM = lambda x: f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
#: CTEs hits, one, clarify and unknown, of req (req, mention) and cat (code, name).
_RESOLVE = f"""
exact_ AS (SELECT r.req, c.code, c.name FROM req r JOIN cat c ON {_NORM("r.mention")} = {_NORM("c.name")}),
hits AS (SELECT req, code, name, true AS whole FROM exact_ UNION SELECT r.req, c.code, c.name, false FROM req r JOIN cat c ON contains(' ' || {_NORM("c.name")} || ' ', ' ' || {_NORM("r.mention")} || ' ')
  WHERE length({_NORM("r.mention")}) >= 3 AND r.req NOT IN (SELECT req FROM exact_)),
one AS (SELECT req, min(code) AS code FROM hits GROUP BY req HAVING count(*) = 1),
clarify AS (SELECT req, name AS candidate FROM (SELECT *, row_number() OVER (PARTITION BY req ORDER BY name, code) AS k, count(*) OVER (PARTITION BY req) AS n FROM hits) WHERE n > 1 AND (whole OR k <= 3)),
unknown AS (SELECT req, mention FROM req WHERE mention IS NOT NULL AND req NOT IN (SELECT req FROM hits))"""
#: The envelope of data (req, row, source), missing (req, item, reason) and clarify.
_ANSWER = """
SELECT r.req, CASE WHEN len(clarifications) > 0 THEN 'ambiguous' WHEN len(data) = 0 THEN 'not_found' WHEN len(missing) > 0 THEN 'partial' ELSE 'ok' END AS status, data, missing, clarifications, sources
FROM (SELECT q.req,
  CASE WHEN q.req IN (SELECT req FROM clarify) THEN [] ELSE coalesce((SELECT list(DISTINCT row ORDER BY row) FROM data d WHERE d.req = q.req), []) END AS data,
  CASE WHEN q.req IN (SELECT req FROM clarify) THEN [] ELSE coalesce((SELECT list(DISTINCT item || ': ' || reason ORDER BY item || ': ' || reason) FROM missing m WHERE m.req = q.req), []) END AS missing,
  coalesce((SELECT list(DISTINCT candidate ORDER BY candidate) FROM clarify c WHERE c.req = q.req), []) AS clarifications,
  CASE WHEN q.req IN (SELECT req FROM clarify) THEN [] ELSE coalesce((SELECT list(DISTINCT source ORDER BY source) FROM data d WHERE d.req = q.req), []) END AS sources FROM (SELECT DISTINCT req FROM req) q) r"""


def _requests(t, schema: str, rows: list[tuple]):
    return t.spark.createDataFrame(rows, schema)


def _values(rows: list[tuple]) -> str:
    show = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    return "(VALUES " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows) + ")"


# ---------------------------------------------------------------- scores: entity x method x year, methods in two levels
_METHODS = [("1-URGENT", "HIGH"), ("2-HIGH", "HIGH"), ("3-MEDIUM", None), ("4-NOT SPECIFIED", "LOW"), ("5-LOW", "LOW")]
_SCORES = [(1, "NATION_3", "HIGH", 1997), (2, "nation 4", None, None), (3, "Nation", "HIGH", 1997), (4, "Atlantis", "HIGH", 1997), (5, "NATION_5", "HIGH", 1950), (6, "NATION_6", "9-NEVER", 1997), (7, "NATION_7", "3-MEDIUM", 1998), (8, "NATION_8", "LOW", None)]
_SCORES_SQL = f"""
WITH req(req, mention, method, year) AS {_values(_SCORES)}, cat AS (SELECT n_nationkey AS code, n_name AS name FROM nation), methods(child, parent) AS {_values(_METHODS)}, {_RESOLVE},
fact AS (SELECT c_nationkey AS code, year(o_orderdate) AS year, o_orderpriority AS method, max(CAST(o_totalprice AS DECIMAL(15,2))) AS best, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 250000 GROUP BY ALL),
asked AS (SELECT r.req, o.code, coalesce(r.year, (SELECT max(year) FROM fact)) AS year, m.child AS method FROM req r JOIN one o USING (req) JOIN methods m ON r.method IS NULL OR m.child = r.method OR m.parent = r.method),
data AS (SELECT req, concat_ws('|', year, method, n, best, best - (SELECT p.best FROM fact p WHERE p.code = f.code AND p.method = f.method AND p.year < f.year ORDER BY p.year DESC LIMIT 1)) AS row, 'orders ' || year AS source
  FROM asked JOIN fact f USING (code, year, method)),
missing AS (SELECT req, mention AS item, 'unknown' AS reason FROM unknown
  UNION ALL SELECT r.req, r.method, 'unknown method' FROM req r JOIN one USING (req) WHERE r.method IS NOT NULL AND r.method NOT IN (SELECT child FROM methods UNION SELECT parent FROM methods WHERE parent IS NOT NULL)
  UNION ALL SELECT a.req, a.method || ' ' || a.year, CASE WHEN a.year NOT IN (SELECT year FROM fact) THEN 'year not covered' WHEN NOT EXISTS (SELECT 1 FROM fact f WHERE f.code = a.code AND f.method = a.method) THEN 'method not offered' ELSE 'no row' END
    FROM asked a WHERE NOT EXISTS (SELECT 1 FROM fact f WHERE f.code = a.code AND f.year = a.year AND f.method = a.method))
{_ANSWER}"""


@query("tool_scores", _SCORES_SQL)
def tool_scores(t):
    """Best order of an entity by method and year, with the difference to its last year that has one; what is missing, and why."""
    req = _requests(t, "req int, mention string, method string, year int", _SCORES)
    found, clarify, unknown = resolved(req, t.nation.select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name")))
    methods = _requests(t, "child string, parent string", _METHODS)
    orders = t.orders.where("o_totalprice > 250000").join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    fact = orders.groupBy(F.col("c_nationkey").alias("code"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("method"))
    fact = fact.agg(F.max(F.col("o_totalprice").cast("decimal(15,2)")).alias("best"), F.count("*").alias("n"))
    fact = fact.withColumn("change", F.col("best") - F.lag("best").over(Window.partitionBy("code", "method").orderBy("year")))
    latest = fact.agg(F.max("year").alias("latest"))
    named = req.join(found, "req")
    offered = F.broadcast(methods)
    asked = named.join(offered, F.col("method").isNull() | (F.col("child") == F.col("method")) | (F.col("parent") == F.col("method"))).crossJoin(F.broadcast(latest))
    asked = asked.select("req", "code", F.coalesce("year", "latest").alias("year"), F.col("child").alias("method"))
    both = asked.join(fact, ["code", "year", "method"], "left").join(F.broadcast(fact.select(F.col("year").alias("covered")).distinct()), F.col("year") == F.col("covered"), "left")
    both = both.join(fact.select("code", "method", F.lit(True).alias("offered")).distinct(), ["code", "method"], "left")
    data = both.where("n IS NOT NULL").select("req", F.concat_ws("|", "year", "method", "n", "best", "change").alias("row"), F.concat(F.lit("orders "), "year").alias("source"))
    reason = F.when(F.col("covered").isNull(), "year not covered").when(F.col("offered").isNull(), "method not offered").otherwise("no row")
    lost = both.where("n IS NULL").select("req", F.concat_ws(" ", "method", "year").alias("item"), reason.alias("reason"))
    known = {x for m in _METHODS for x in m if x}
    strange = named.where(F.col("method").isNotNull() & ~F.col("method").isin(*sorted(known))).select("req", F.col("method").alias("item"), F.lit("unknown method").alias("reason"))
    missing = unknown.select("req", F.col("mention").alias("item"), F.lit("unknown").alias("reason")).unionByName(strange).unionByName(lost)
    return envelope(req, data, missing, clarify)


# ---------------------------------------------------------------- lists: ranks with ties in a region, statistics before the limit
_LISTS = [(1, "ASIA", "score", None, None, 3), (2, "europe", "quota", None, 60, 2), (3, "a", "score", None, None, 3), (4, "Nowhere", "score", None, None, 3), (5, "AFRICA", "score", 480000, 490000, 5), (6, "AMERICA", "score", None, None, 0), (7, None, "quota", None, None, 1)]
_LISTS_SQL = f"""
WITH req(req, mention, metric, lo, hi, lim) AS {_values(_LISTS)}, cat AS (SELECT r_regionkey AS code, r_name AS name FROM region), {_RESOLVE},
per AS (SELECT n_regionkey AS code, n_name AS name, year(o_orderdate) AS year, max(CAST(o_totalprice AS DECIMAL(15,2))) AS score, CAST(count(*) AS DECIMAL(15,2)) AS quota FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
valid AS (SELECT r.*, o.code FROM req r LEFT JOIN one o USING (req) WHERE lim BETWEEN 1 AND 100 AND (mention IS NULL OR o.code IS NOT NULL)),
fits AS (SELECT v.req, v.lim, p.name, p.year, CASE v.metric WHEN 'score' THEN p.score ELSE p.quota END AS value FROM valid v JOIN per p ON (v.code IS NULL OR p.code = v.code) AND p.year = (SELECT max(year) FROM per)
  WHERE CASE v.metric WHEN 'score' THEN p.score ELSE p.quota END BETWEEN coalesce(v.lo, -1) AND coalesce(v.hi, 1e9)),
ranked AS (SELECT *, (SELECT count(*) + 1 FROM fits g WHERE g.req = f.req AND g.value > f.value) AS rnk FROM fits f),
data AS (SELECT req, concat_ws('|', 'row', rnk, name, value) AS row, 'orders ' || year AS source FROM ranked WHERE rnk <= lim
  UNION ALL SELECT req, concat_ws('|', 'stats', count(*), min(value), max(value), CASE WHEN count(*) FILTER (WHERE rnk <= lim) < count(*) THEN 'truncated' ELSE 'whole' END), 'orders ' || min(year) FROM ranked GROUP BY req),
missing AS (SELECT req, mention AS item, 'unknown' AS reason FROM unknown UNION ALL SELECT req, 'input', 'limit out of 1 to 100' FROM req WHERE lim NOT BETWEEN 1 AND 100)
{_ANSWER}"""


@query("tool_list", _LISTS_SQL)
def tool_list(t):
    """The first ranks of a region's nations in the latest year, all ties, with count, lowest and highest of all rows before the limit.
    A region that isn't known gives no rows, never all of them."""
    req = _requests(t, "req int, mention string, metric string, lo int, hi int, lim int", _LISTS)
    found, clarify, unknown = resolved(req, t.region.select(F.col("r_regionkey").alias("code"), F.col("r_name").alias("name")))
    bad = invalid(req, {"limit out of 1 to 100": ~F.col("lim").between(1, 100)})
    per = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", F.year("o_orderdate").alias("year"))
    per = per.agg(F.max(F.col("o_totalprice").cast("decimal(15,2)")).alias("score"), F.count("*").cast("decimal(15,2)").alias("quota"))
    per = per.withColumn("latest", F.max("year").over(Window.partitionBy(F.lit(0)))).where("year = latest")  # a row per nation and year
    per = per.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("region"), F.col("n_name").alias("name"), "year", "score", "quota")
    valid = req.where("lim BETWEEN 1 AND 100").join(found, "req", "left").where("mention IS NULL OR code IS NOT NULL")
    fits = per.join(F.broadcast(valid), F.col("code").isNull() | (F.col("code") == F.col("region"))).withColumn("value", F.when(F.col("metric") == "score", F.col("score")).otherwise(F.col("quota")))
    fits = fits.where("(lo IS NULL OR value >= lo) AND (hi IS NULL OR value <= hi)").withColumn("rnk", F.rank().over(Window.partitionBy("req").orderBy(F.desc("value"))))
    source = F.concat(F.lit("orders "), "year").alias("source")
    shown = fits.where("rnk <= lim").select("req", F.concat_ws("|", F.lit("row"), "rnk", "name", "value").alias("row"), source)
    stats = fits.groupBy("req", "year").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), (F.count_if(F.col("rnk") <= F.col("lim")) < F.count("*")).alias("cut"))
    stats = stats.select("req", F.concat_ws("|", F.lit("stats"), "n", "low", "high", F.when(F.col("cut"), "truncated").otherwise("whole")).alias("row"), source)
    missing = unknown.select("req", F.col("mention").alias("item"), F.lit("unknown").alias("reason")).unionByName(bad)
    return envelope(req, shown.unionByName(stats), missing, clarify)


# ---------------------------------------------------------------- info: the sections of an entity that are asked for
_INFO = [(1, "Supplier#000000001", "overview;quota"), (2, "supplier 000000002", "overview;methods;history"), (3, "supplier", "overview"), (4, "Supplier#999999999", "overview"), (5, "Supplier#000000005", None)]
_INFO_SQL = f"""
WITH req(req, mention, sections) AS {_values(_INFO)}, cat AS (SELECT s_suppkey AS code, s_name AS name FROM supplier), {_RESOLVE},
asked AS (SELECT r.req, o.code, unnest(string_split(coalesce(r.sections, 'overview;quota;methods'), ';')) AS section FROM req r JOIN one o USING (req)),
data AS (SELECT req, concat_ws('|', section, n_name, CAST(s_acctbal AS DECIMAL(15,2))) AS row, 'supplier' AS source FROM asked JOIN supplier ON s_suppkey = code JOIN nation ON s_nationkey = n_nationkey WHERE section = 'overview'
  UNION ALL SELECT req, concat_ws('|', section, year(l_shipdate), CAST(sum(l_quantity) AS BIGINT)), 'lineitem' FROM asked JOIN lineitem ON l_suppkey = code WHERE section = 'quota' GROUP BY req, section, year(l_shipdate)
  UNION ALL SELECT req, concat_ws('|', section, l_returnflag), 'lineitem' FROM asked JOIN lineitem ON l_suppkey = code WHERE section = 'methods'),
missing AS (SELECT req, mention AS item, 'unknown' AS reason FROM unknown UNION ALL SELECT req, section, 'no such section' FROM asked WHERE section NOT IN ('overview', 'quota', 'methods'))
{_ANSWER}"""


@query("tool_info", _INFO_SQL)
def tool_info(t):
    """Sections overview, quota and methods of an entity: those asked for, or all."""
    req = _requests(t, "req int, mention string, sections string", _INFO)
    found, clarify, unknown = resolved(req, t.supplier.select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("name")))
    asked = req.join(found, "req").select("req", "code", F.explode(F.split(F.coalesce("sections", F.lit("overview;quota;methods")), ";")).alias("section"))
    of = lambda section: F.broadcast(asked.where(F.col("section") == section))
    place = t.supplier.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey"))
    overview = place.join(of("overview"), F.col("s_suppkey") == F.col("code")).select("req", F.concat_ws("|", "section", "n_name", F.col("s_acctbal").cast("decimal(15,2)")).alias("row"), F.lit("supplier").alias("source"))
    quota = t.lineitem.join(of("quota"), F.col("l_suppkey") == F.col("code")).groupBy("req", "section", F.year("l_shipdate").alias("year")).agg(F.sum("l_quantity").cast("long").alias("n"))
    methods = t.lineitem.join(of("methods"), F.col("l_suppkey") == F.col("code")).select("req", F.concat_ws("|", "section", "l_returnflag").alias("row")).distinct()
    data = overview.unionByName(quota.select("req", F.concat_ws("|", "section", "year", "n").alias("row"), F.lit("lineitem").alias("source"))).unionByName(methods.withColumn("source", F.lit("lineitem")))
    strange = asked.where(~F.col("section").isin("overview", "quota", "methods")).select("req", F.col("section").alias("item"), F.lit("no such section").alias("reason"))
    return envelope(req, data, unknown.select("req", F.col("mention").alias("item"), F.lit("unknown").alias("reason")).unionByName(strange), clarify)


# ---------------------------------------------------------------- fees: kinds with rules of their own; a flat rule suppresses general ones
_FEES = [(1, "cold widget", "unit"), (2, "cold widget", "rule"), (3, "small widget", None), (4, "large bolt", "yearly"), (5, "nothing like it", "unit")]
_RULES = [("PROMO", 5, 120, "flat"), ("PROMO", None, 90, "general"), ("ECONOMY", None, 80, "general"), ("STANDARD", 10, 70, "general"), (None, None, 60, "general")]
_FEES_SQL = f"""
WITH req(req, mention, kind) AS {_values(_FEES)}, rules(type, least_size, fee, how) AS {_values(_RULES)}, p AS (SELECT p_name AS name, p_type, min(p_size) AS size, min(CAST(p_retailprice AS DECIMAL(15,2))) AS low, max(CAST(p_retailprice AS DECIMAL(15,2))) AS high, count(*) AS n FROM part GROUP BY 1, 2),
cat AS (SELECT DISTINCT name AS code, name FROM p), {_RESOLVE},
kinds AS (SELECT req, code, unnest(CASE WHEN kind IS NULL THEN ['unit', 'rule'] ELSE [kind] END) AS kind FROM req JOIN one USING (req)),
applied AS (SELECT k.req, p.p_type, r.fee, r.how FROM kinds k JOIN p ON p.name = k.code JOIN rules r ON (r.type IS NULL OR r.type = p.p_type) AND (r.least_size IS NULL OR p.size >= r.least_size) WHERE k.kind = 'rule'),
data AS (SELECT req, concat_ws('|', 'unit', p_type, low, high, n) AS row, 'part' AS source FROM kinds JOIN p ON name = code WHERE kind = 'unit'
  UNION ALL SELECT req, concat_ws('|', 'rule', p_type, fee, how), 'rules' FROM applied a WHERE how = 'flat' OR NOT EXISTS (SELECT 1 FROM applied b WHERE b.req = a.req AND b.p_type = a.p_type AND b.how = 'flat')),
missing AS (SELECT req, mention AS item, 'unknown' AS reason FROM unknown UNION ALL SELECT req, kind, 'not collected' FROM kinds WHERE kind NOT IN ('unit', 'rule'))
{_ANSWER}"""


@query("tool_fees", _FEES_SQL)
def tool_fees(t):
    """Prices by type (unit) and the rules that apply (rule): where a flat rule does, general ones don't. No price is turned into another kind's."""
    req = _requests(t, "req int, mention string, kind string", _FEES)
    rules = F.broadcast(_requests(t, "type string, least_size int, fee int, how string", _RULES))
    p = t.part.groupBy(F.col("p_name").alias("name"), "p_type").agg(F.min("p_size").alias("size"), F.min(F.col("p_retailprice").cast("decimal(15,2)")).alias("low"), F.max(F.col("p_retailprice").cast("decimal(15,2)")).alias("high"), F.count("*").alias("n"))
    found, clarify, unknown = resolved(req, p.select(F.col("name").alias("code"), "name").distinct())
    kinds = req.join(found, "req").select("req", "code", F.explode(F.when(F.col("kind").isNull(), F.array(F.lit("unit"), F.lit("rule"))).otherwise(F.array("kind"))).alias("kind"))
    of = lambda kind: p.join(F.broadcast(kinds.where(F.col("kind") == kind)), F.col("name") == F.col("code"))
    unit = of("unit").select("req", F.concat_ws("|", "kind", "p_type", "low", "high", "n").alias("row"), F.lit("part").alias("source"))
    fits = (F.col("type").isNull() | (F.col("type") == F.col("p_type"))) & (F.col("least_size").isNull() | (F.col("size") >= F.col("least_size")))
    applied = of("rule").join(rules, fits).withColumn("flat", F.max((F.col("how") == "flat").cast("int")).over(Window.partitionBy("req", "p_type")))
    rule = applied.where("flat = 0 OR how = 'flat'").select("req", F.concat_ws("|", "kind", "p_type", "fee", "how").alias("row"), F.lit("rules").alias("source"))
    strange = kinds.where(~F.col("kind").isin("unit", "rule")).select("req", F.col("kind").alias("item"), F.lit("not collected").alias("reason"))
    return envelope(req, unit.unionByName(rule), unknown.select("req", F.col("mention").alias("item"), F.lit("unknown").alias("reason")).unionByName(strange), clarify)


# ---------------------------------------------------------------- lookup: a value in a table of ranges, by purpose; whether it meets a level
_PURPOSES = ("price", "size")
_LOOKUP_SQL = f"""
WITH req AS (SELECT p_partkey AS req, CASE WHEN p_partkey % 10 = 9 THEN NULL WHEN p_partkey % 10 = 8 THEN 'colour' WHEN p_partkey % 2 = 0 THEN 'size' ELSE 'price' END AS purpose, CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 25 END AS need,
  CASE p_partkey % 7 WHEN 0 THEN '' || p_size WHEN 1 THEN '≥ ' || p_size WHEN 2 THEN p_size || '-' || (p_size + 5) WHEN 3 THEN 'a NATION_' || (p_partkey % 30) WHEN 4 THEN p_size || '.5' WHEN 5 THEN 'unheard of' ELSE '' || (p_size * 20 + 880) END AS value FROM part),
levels AS (SELECT purpose, CAST(CASE purpose WHEN 'size' THEN 2 * n_nationkey ELSE 900 + 40 * n_nationkey END AS INTEGER) AS lo, CAST(CASE WHEN n_nationkey < 24 THEN CASE purpose WHEN 'size' THEN 2 * n_nationkey + 3 ELSE 940 + 40 * n_nationkey END END AS INTEGER) AS hi, {_NORM("n_name")} AS level, n_nationkey AS place FROM nation, (VALUES ('size'), ('price')) AS x(purpose)),
parsed AS (SELECT *, TRY_CAST(regexp_extract(value, '^[≥>= ]*([0-9]+([.][0-9]+)?)', 1) AS DOUBLE) AS a, CASE WHEN value LIKE '≥%' THEN 1e308 ELSE coalesce(TRY_CAST(regexp_extract(value, '[0-9] *- *([0-9]+([.][0-9]+)?)$', 1) AS DOUBLE), TRY_CAST(regexp_extract(value, '^ *([0-9]+([.][0-9]+)?)', 1) AS DOUBLE)) END AS z FROM req),
got AS (SELECT p.req, p.value, p.need, l.level, l.place, p.purpose FROM parsed p JOIN levels l ON l.purpose = p.purpose AND CASE WHEN p.a IS NOT NULL THEN p.z >= l.lo AND (l.hi IS NULL OR p.a <= l.hi) ELSE contains(' ' || {_NORM("p.value")} || ' ', ' ' || l.level || ' ') END),
clarify AS (SELECT req, unnest(['price', 'size']) AS candidate FROM req WHERE purpose IS NULL),
data AS (SELECT req, concat_ws('|', 'level', level) AS row, 'levels ' || purpose AS source FROM got
  UNION ALL SELECT req, concat_ws('|', 'meets', CASE WHEN any_value(need) IS NULL THEN 'unknown' WHEN min(place) >= any_value(need) THEN 'yes' ELSE 'no' END), 'levels ' || any_value(purpose) FROM got GROUP BY req
  UNION ALL SELECT p.req, concat_ws('|', 'table', l.level, l.lo, l.hi), 'levels ' || l.purpose FROM parsed p JOIN levels l USING (purpose) WHERE p.req NOT IN (SELECT req FROM got)),
missing AS (SELECT req, purpose AS item, 'not collected' AS reason FROM req WHERE purpose NOT IN ('price', 'size') UNION ALL SELECT req, value, 'no match: the whole table' FROM req WHERE purpose IN ('price', 'size') AND req NOT IN (SELECT req FROM got))
{_ANSWER}"""


@query("tool_lookup", _LOOKUP_SQL)
def tool_lookup(t):
    """Levels whose closed range a value, an interval or an open bound meets; words are looked for in the levels' names. The lowest of the
    levels must reach the one needed: yes, no or unknown. Without a match the whole table is returned. Without a purpose it is asked back."""
    k, n = F.col("p_partkey"), F.col("p_size")
    put = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    value = F.when(k % 7 == 0, put(n)).when(k % 7 == 1, put("≥ ", n)).when(k % 7 == 2, put(n, "-", n + 5)).when(k % 7 == 3, put("a NATION_", k % 30)).when(k % 7 == 4, put(n, ".5")).when(k % 7 == 5, "unheard of").otherwise(put(n * 20 + 880))
    req = t.part.select(k.alias("req"), F.when(k % 10 == 9, None).when(k % 10 == 8, "colour").when(k % 2 == 0, "size").otherwise("price").alias("purpose"), value.alias("value"), F.when(k % 3 > 0, k % 25).alias("need"))
    at, last = F.col("n_nationkey"), F.col("n_nationkey") < 24
    band = lambda purpose, lo, wide: t.nation.select(F.lit(purpose).alias("purpose"), lo.alias("lo"), F.when(last, lo + wide).alias("hi"), plain(F.col("n_name")).alias("level"), at.alias("place"))
    levels = band("size", 2 * at, 3).unionByName(band("price", 900 + 40 * at, 40))
    number = lambda pattern, group: F.nullif(F.regexp_extract("value", pattern, group), F.lit("")).cast("double")
    a, z = number(r"^[≥>= ]*([0-9]+([.][0-9]+)?)", 1), F.coalesce(number(r"[0-9] *- *([0-9]+([.][0-9]+)?)$", 1), number(r"^ *([0-9]+([.][0-9]+)?)", 1))
    parsed = req.withColumn("a", a).withColumn("z", F.when(~F.col("value").startswith("≥"), z))
    columns = ("req", "purpose", "need", "level", "place")
    ranged = join_overlaps(parsed.where("a IS NOT NULL"), levels, "a", "z", "lo", "hi", ["purpose"]).select(*columns)
    words = F.split(plain(F.col("value")), " ")  # a level's name is one of the value's runs of words
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.transform(F.sequence(F.lit(1), F.size(words) - i + 1), lambda m: F.array_join(F.slice(words, i, m), " "))))
    named = parsed.where("a IS NULL").withColumn("level", F.explode(F.array_distinct(runs))).join(levels, ["purpose", "level"]).select(*columns)
    hits = ranged.unionByName(named)
    source = F.concat(F.lit("levels "), "purpose").alias("source")
    meets = hits.groupBy("req", "purpose").agg(F.min("place").alias("least"), F.first("need").alias("need")).select("req", F.concat_ws("|", F.lit("meets"), F.when(F.col("need").isNull(), "unknown").when(F.col("least") >= F.col("need"), "yes").otherwise("no")).alias("row"), source)
    without = parsed.where(F.col("purpose").isin(*_PURPOSES)).join(hits.select("req").distinct(), "req", "left_anti")
    whole = without.join(levels, "purpose").select("req", F.concat_ws("|", F.lit("table"), "level", "lo", "hi").alias("row"), source)
    data = hits.select("req", F.concat_ws("|", F.lit("level"), "level").alias("row"), source).unionByName(meets).unionByName(whole)
    strange = req.where(~F.col("purpose").isin(*_PURPOSES)).select("req", F.col("purpose").alias("item"), F.lit("not collected").alias("reason"))
    unmatched = without.select("req", F.col("value").alias("item"), F.lit("no match: the whole table").alias("reason"))
    clarify = req.where("purpose IS NULL").select("req", F.explode(F.array(*map(F.lit, _PURPOSES))).alias("candidate"))
    return envelope(req, data, strange.unionByName(unmatched), clarify)


# ---------------------------------------------------------------- organisation: an ambiguous mention whose candidates share a unit is answered
_ORG = [(1, "Supplier#000000003", "nation"), (2, "NATION_7", "suppliers"), (3, "nation", "suppliers"), (4, "ASIA", "members"), (5, "Nobody", "nation"), (6, "cold widget", "brand"), (7, "hot widget", "types")]
_ORG_SQL = f"""
WITH req(req, mention, topic) AS {_values(_ORG)},
units AS (SELECT 'S' || s_suppkey AS code, s_name AS name, 'nation|' || n_name AS fact, 'nation' AS topic, 'supplier' AS source, n_name AS unit FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'N' || n_nationkey, n_name, 'suppliers|' || count(s_suppkey), 'suppliers', 'nation', r_name FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_nationkey, n_name, r_name
  UNION ALL SELECT 'R' || r_regionkey, r_name, 'members|' || count(*), 'members', 'region', r_name FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name
  UNION ALL SELECT 'P' || p_name || '/' || p_type, p_name, 'types|' || p_type, 'types', 'part', p_name FROM part GROUP BY p_name, p_type),
cat AS (SELECT DISTINCT code, name FROM units), {_RESOLVE.replace("clarify AS", "several AS")},
shared AS (SELECT req FROM several JOIN units u ON u.name = candidate GROUP BY req HAVING count(DISTINCT u.unit) = 1),
clarify AS (SELECT * FROM several WHERE req NOT IN (SELECT req FROM shared)),
chosen AS (SELECT req, code FROM one UNION SELECT h.req, h.code FROM hits h JOIN shared USING (req)),
data AS (SELECT c.req, u.fact AS row, u.source FROM chosen c JOIN units u USING (code) JOIN req r USING (req) WHERE u.topic = r.topic),
missing AS (SELECT req, mention AS item, 'unknown' AS reason FROM unknown UNION ALL SELECT r.req, r.topic, 'no such topic here' FROM req r WHERE r.req IN (SELECT req FROM chosen) AND r.req NOT IN (SELECT req FROM data))
{_ANSWER}"""


@query("tool_org", _ORG_SQL)
def tool_org(t):
    """Facts of units of several kinds by topic. Candidates that all belong to one unit are answered together instead of asked back;
    internal columns (balances) are never read."""
    req = _requests(t, "req int, mention string, topic string", _ORG)
    unit = lambda df, code, name, fact, topic, source, of: df.select(F.concat(F.lit(code[0]), *code[1]).alias("code"), F.col(name).alias("name"), F.concat(F.lit(topic + "|"), F.col(fact).cast("string")).alias("fact"), F.lit(topic).alias("about"), F.lit(source).alias("source"), F.col(of).alias("unit"))
    nations, regions, suppliers = t.nation, F.broadcast(t.region), t.supplier.select("s_suppkey", "s_name", "s_nationkey")
    placed = suppliers.join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey"))
    counted = nations.join(suppliers.groupBy("s_nationkey").count(), F.col("s_nationkey") == F.col("n_nationkey"), "left").fillna(0, ["count"]).join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    members = nations.groupBy("n_regionkey").agg(F.count("*").alias("n")).join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    types = t.part.select("p_name", "p_type").distinct()
    units = unit(placed, ("S", ["s_suppkey"]), "s_name", "n_name", "nation", "supplier", "n_name").unionByName(unit(counted, ("N", ["n_nationkey"]), "n_name", "count", "suppliers", "nation", "r_name"))
    units = units.unionByName(unit(members, ("R", ["r_regionkey"]), "r_name", "n", "members", "region", "r_name")).unionByName(unit(types, ("P", ["p_name", F.lit("/"), "p_type"]), "p_name", "p_type", "types", "part", "p_name"))
    found, several, unknown = resolved(req, units.select("code", "name").distinct())
    shared = several.join(units, F.col("candidate") == F.col("name")).groupBy("req").agg(F.countDistinct("unit").alias("k")).where("k = 1").select("req")
    together = several.join(shared, "req").join(units.select("code", "name"), F.col("candidate") == F.col("name")).select("req", "code")
    chosen = found.unionByName(together).distinct().join(req, "req")
    data = chosen.join(units, "code").where("about = topic").select("req", F.col("fact").alias("row"), "source")
    nothing = chosen.select("req", "topic").distinct().join(data.select("req"), "req", "left_anti").select("req", F.col("topic").alias("item"), F.lit("no such topic here").alias("reason"))
    return envelope(req, data, unknown.select("req", F.col("mention").alias("item"), F.lit("unknown").alias("reason")).unionByName(nothing), several.join(shared, "req", "left_anti"))
