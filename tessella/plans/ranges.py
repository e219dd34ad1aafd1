"""Ranges and periods: values in ranges that tables hold, years asked for and not covered; wide rows turned into long ones, rows derived by rule, deferrals counted."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.operators.intervals import join_ranges
from tessella.plans import query


@query("range_lookup_tables", """WITH bands AS (SELECT c_custkey, c_mktsegment, round(abs(c_acctbal) * 45) AS lo, CASE WHEN c_custkey % 100 = 7 THEN NULL ELSE round(abs(c_acctbal) * 45) + c_custkey % 60 END AS hi FROM customer WHERE c_custkey % 100 <> 7 OR abs(c_acctbal) > 9900)
SELECT o_orderkey, c_custkey FROM orders JOIN bands ON round(o_totalprice) >= lo AND (hi IS NULL OR round(o_totalprice) <= hi)""")
def range_lookup_tables(t):
    """Orders in the price bands that customers' balances set, both ends belonging to a band, some bands open above."""
    lo = F.round(F.abs("c_acctbal") * 45)
    bands = t.customer.where("c_custkey % 100 <> 7 OR abs(c_acctbal) > 9900").select("c_custkey", lo.alias("lo"), F.when(F.col("c_custkey") % 100 != 7, lo + F.col("c_custkey") % 60).alias("hi"))
    prices = t.orders.select("o_orderkey", F.round("o_totalprice").alias("price"))
    return join_ranges(prices, bands, "price", "lo", "hi").select("o_orderkey", "c_custkey")


@query("range_lookup_words", """WITH l AS (SELECT n_nationkey AS place, 'level ' || (n_nationkey % 7) AS name, CAST(2 * n_nationkey AS DOUBLE) AS lo, CASE WHEN n_nationkey < 20 THEN CAST(2 * n_nationkey + 4 AS DOUBLE) END AS hi FROM nation),
p AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS v, CASE WHEN p_partkey % 3 = 0 THEN 'Level-' || (p_partkey % 9) END AS word FROM part),
hit AS (SELECT p_partkey, place FROM p JOIN l ON (v >= lo AND (hi IS NULL OR v <= hi)) OR name = replace(lower(word), '-', ' '))
SELECT p_partkey, place, true AS matched FROM hit UNION ALL SELECT p_partkey, place, false FROM p, l WHERE p_partkey NOT IN (SELECT p_partkey FROM hit)""")
def range_lookup_words(t):
    """Numbers by the range that they are in, words by the name that they are; what matches nothing gets the whole table, marked as such."""
    k = F.col("p_partkey")
    at = F.col("n_nationkey")
    levels = t.nation.select(at.alias("place"), F.concat(F.lit("level "), (at % 7).cast("string")).alias("name"), (2 * at).cast("double").alias("lo"), F.when(at < 20, (2 * at + 4).cast("double")).alias("hi"))
    asked = t.part.select("p_partkey", F.when(k % 3 != 0, F.col("p_size").cast("double")).alias("v"), F.when(k % 3 == 0, F.concat(F.lit("Level-"), (k % 9).cast("string"))).alias("word"))
    numbers = join_ranges(asked.where("v IS NOT NULL"), levels, "v", "lo", "hi").select("p_partkey", "place")
    words = asked.where("word IS NOT NULL").withColumn("name", F.replace(F.lower("word"), F.lit("-"), F.lit(" "))).join(levels, "name").select("p_partkey", "place")
    hits = numbers.unionByName(words)
    rest = asked.join(hits.select("p_partkey").distinct(), "p_partkey", "left_anti").select("p_partkey").crossJoin(F.broadcast(levels.select("place")))  # the table of levels is what is asked for
    return hits.withColumn("matched", F.lit(True)).unionByName(rest.withColumn("matched", F.lit(False)))


@query("period_pick", """WITH y AS (SELECT list_sort(list(DISTINCT CAST(year(o_orderdate) AS INTEGER))) AS have FROM orders), r AS (SELECT c_custkey, unnest(CASE c_custkey % 4 WHEN 0 THEN [NULL] WHEN 1 THEN [1996] WHEN 2 THEN [1950, 1997] ELSE [2050] END) AS asked FROM customer)
SELECT c_custkey, coalesce(asked, have[-1]) AS year, CASE WHEN asked IS NULL OR list_contains(have, asked) THEN 'ok' ELSE 'year_out_of_range' END AS status, CASE WHEN asked IS NULL OR list_contains(have, asked) THEN NULL ELSE have END AS available FROM r, y""")
def period_pick(t):
    """The years that a request asks for, the last one with data where it asks for none; years without data are reported with those that have some, the others stay."""
    c = F.col("c_custkey")
    have = t.orders.select(F.year("o_orderdate").alias("y")).distinct().agg(F.sort_array(F.collect_set("y")).alias("have"))  # a row of distinct years
    asked = F.when(c % 4 == 0, F.array(F.lit(None).cast("int"))).when(c % 4 == 1, F.array(F.lit(1996))).when(c % 4 == 2, F.array(F.lit(1950), F.lit(1997))).otherwise(F.array(F.lit(2050)))
    rows = t.customer.select("c_custkey", F.explode(asked).alias("asked")).crossJoin(F.broadcast(have))
    fine = F.col("asked").isNull() | F.array_contains("have", F.col("asked"))
    return rows.select("c_custkey", F.coalesce("asked", F.element_at("have", -1)).alias("year"), F.when(fine, "ok").otherwise("year_out_of_range").alias("status"), F.when(~fine, F.col("have")).alias("available"))


_WIDE = "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE CAST(p_size AS VARCHAR(9)) END AS size, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_type END AS type, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END AS brand FROM part"


@query("unpivot", f"SELECT p_partkey, field, value FROM ({' UNION ALL '.join(f'''SELECT p_partkey, '{c}' AS field, {c} AS value FROM ({_WIDE}) x''' for c in ('size', 'type', 'brand'))}) u WHERE trim(coalesce(value, '')) <> ''")
def unpivot(t):
    """A row for each column that has something in it: nulls and blanks are left out."""
    k = F.col("p_partkey")
    wide = t.part.select("p_partkey", F.when(k % 5 == 0, " ").otherwise(F.col("p_size").cast("string")).alias("size"), F.when(k % 7 != 0, F.col("p_type")).alias("type"), F.when(k % 3 == 0, "").otherwise(F.col("p_brand")).alias("brand"))
    return wide.unpivot("p_partkey", ["size", "type", "brand"], "field", "value").where(F.trim("value") != "")


#: The groups that combinations belong to, how far the first lies above the second, the years with a rule of their own, and the years that take another's.
GROUPS, GAP, RULED, PROXY = {"technical": ("A00", "A01"), "economic": ("D01", "D07")}, 0.5, (1,), {2: 1}


@query("rule_rows", """WITH p AS (SELECT p_partkey, CAST(p_partkey % 3 + 1 AS INTEGER) AS year, CAST(p_size AS DOUBLE) AS given, CASE WHEN p_partkey % 2 = 0 THEN 'A00' ELSE 'D01' END AS base,
  list_filter(['A00', 'A01', 'D01', 'D07'], lambda c: c = CASE WHEN p_partkey % 2 = 0 THEN 'A00' ELSE 'D01' END OR (p_partkey + CAST(substr(c, 3, 1) AS INTEGER) + CASE WHEN c[1] = 'A' THEN 1 ELSE 0 END) % 4 > 1) AS combos FROM part),
t AS (SELECT *, list_filter(combos, lambda c: c[1] = 'A') AS tech, list_filter(combos, lambda c: c[1] = 'D') AS eco FROM p)
SELECT p_partkey, year, 'all' AS grp, array_to_string(combos, ';') AS combinations, given AS value, 'given' AS status, NULL AS note FROM t WHERE year = 3
UNION ALL SELECT p_partkey, year, 'technical', array_to_string(tech, ';'), CASE WHEN base = 'A00' THEN given ELSE given + 0.5 END, CASE WHEN base = 'A00' THEN 'given' ELSE 'rule_derived' END, CASE WHEN base = 'A00' THEN NULL WHEN year = 1 THEN 'base D01, +0.5' ELSE 'base D01, +0.5, by the rule of year 1' END FROM t WHERE year < 3 AND len(tech) > 0
UNION ALL SELECT p_partkey, year, 'economic', array_to_string(eco, ';'), CASE WHEN base = 'D01' THEN given ELSE given - 0.5 END, CASE WHEN base = 'D01' THEN 'given' ELSE 'rule_derived' END, CASE WHEN base = 'D01' THEN NULL WHEN year = 1 THEN 'base A00, -0.5' ELSE 'base A00, -0.5, by the rule of year 1' END FROM t WHERE year < 3 AND len(eco) > 0""")
def rule_rows(t):
    """A given value split by groups of combinations: the group of the base combination keeps it, the technical one lies half a point above the economic one, on
    either side. Years without a rule take that of their proxy year, and say so; without one a value stays whole."""
    k, given = F.col("p_partkey"), F.col("p_size").cast("double")
    base = F.when(k % 2 == 0, "A00").otherwise("D01")
    codes = [(c, g) for g, cs in GROUPS.items() for c in cs]
    combos = F.array_compact(F.array(*[F.when((base == c) | ((k + (int(c[2]) + (c[0] == "A"))) % 4 > 1), F.lit(c)) for c, _ in codes]))
    rows = t.part.select("p_partkey", (k % 3 + 1).cast("int").alias("year"), given.alias("given"), base.alias("base"), combos.alias("combos"))
    ruled = F.when(F.col("year").isin(*RULED), F.col("year"))
    for year, other in PROXY.items():
        ruled = ruled.when(F.col("year") == year, F.lit(other))

    def part(name, cs, gap):
        own, mine = F.array_intersect("combos", F.array(*map(F.lit, cs))), F.col("base").isin(*cs)
        note = F.concat(F.lit("base "), "base", F.lit(f", {gap:+}"), F.when(F.col("year") != ruled, F.concat(F.lit(", by the rule of year "), ruled.cast("string"))).otherwise(""))
        return F.when((F.size(own) > 0) & ruled.isNotNull(), F.struct(F.lit(name).alias("grp"), F.array_join(own, ";").alias("combinations"), F.when(mine, F.col("given")).otherwise(F.col("given") + gap).alias("value"), F.when(mine, "given").otherwise("rule_derived").alias("status"), F.when(~mine, note).alias("note")))

    undivided = F.when(ruled.isNull(), F.struct(F.lit("all").alias("grp"), F.array_join("combos", ";").alias("combinations"), F.col("given").alias("value"), F.lit("given").alias("status"), F.lit(None).cast("string").alias("note")))
    (upper, above), (lower, below) = GROUPS.items()
    return rows.select("p_partkey", "year", F.explode(F.array_compact(F.array(part(upper, above, GAP), part(lower, below, -GAP), undivided))).alias("r")).select("p_partkey", "year", "r.*")


#: Phrases by which a text leaves something to another place.
DEFERRALS = (("to the", "in ?to the|to the"), ("of it", "de la|of the"), ("there", "in der|dans"))
_COUNTS = " UNION ALL ".join(f"SELECT coalesce(source, '?') AS source, '{label}' AS label, len(regexp_extract_all(text, '{p}')) AS n FROM documents" for label, p in DEFERRALS)


@query("deferral_counts", f"""WITH c AS (SELECT label, source, CAST(sum(n) AS BIGINT) AS n FROM ({_COUNTS}) GROUP BY ALL HAVING sum(n) > 0), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, source) AS k, sum(n) OVER (PARTITION BY label) AS total FROM c)
SELECT label, CAST(any_value(total) AS BIGINT) AS total, list(source || '(' || n || ')' ORDER BY k) AS most FROM r WHERE k <= 3 GROUP BY label""")
def deferral_counts(t):
    """How often texts leave something to another place, by kind of phrase, and the three sources that do so most."""
    counts = F.array(*[F.struct(F.lit(label).alias("label"), F.regexp_count("text", F.lit(p)).alias("n")) for label, p in DEFERRALS])
    sums = t.documents.select(F.coalesce("source", F.lit("?")).alias("source"), F.inline(counts)).groupBy("label", "source").agg(F.sum("n").alias("n")).where("n > 0")
    total = sums.groupBy("label").agg(F.sum("n").alias("total"))
    most = sums.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "source"))).where("k <= 3")
    most = most.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("k", F.concat("source", F.lit("("), F.col("n").cast("string"), F.lit(")")).alias("s")))).alias("m"))
    return total.join(most, "label").select("label", "total", F.transform("m", lambda x: x["s"]).alias("most"))
