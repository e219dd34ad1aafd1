"""Validation rules: each finds its violations as rows of rule, level and key. The driver's tables are the clean catalog; seeded rows
break every rule at least once, so that a rule that finds nothing shows. The SQL states each rule by itself; Spark compiles them into few passes."""

from pyspark.sql import functions as F

from tessella.operators.rules import Checked, Reference, violations
from tessella.plans import query

#: The SQL's tables: the driver's rows and the seeded faults.
_TABLES = """
nations AS (SELECT n_nationkey AS k, n_name AS name, n_regionkey AS region FROM nation UNION ALL SELECT 3, 'NATION_3', 0 UNION ALL SELECT 90, 'NATION_90', 77 UNION ALL SELECT 91, ' nation x ', 1 UNION ALL SELECT 92, NULL, 1),
customers AS (SELECT c_custkey AS k, c_nationkey AS nation, c_mktsegment AS segment, c_acctbal AS balance FROM customer UNION ALL SELECT -1, 500, 'BUILDING', 1.0 UNION ALL SELECT -2, 1, 'SPACE', 1.0 UNION ALL SELECT -3, 1, NULL, 1e9),
suppliers AS (SELECT s_suppkey AS k, s_nationkey AS nation FROM supplier UNION ALL SELECT -1, 501),
bookings AS (SELECT o_orderkey AS k, o_custkey AS customer, o_orderpriority AS method, CAST(year(o_orderdate) AS INTEGER) AS year, o_totalprice AS price FROM orders UNION ALL SELECT -1, -99, '1-URGENT', 1997, 10.0 UNION ALL SELECT -2, 1, '9-NONE', 1997, 10.0 UNION ALL SELECT -3, 1, '1-URGENT', 2090, 10.0 UNION ALL SELECT -4, 1, '1-URGENT', 1997, -5.0),
methods(code, parent) AS (VALUES ('HIGH', NULL), ('LOW', NULL), ('1-URGENT', 'HIGH'), ('2-HIGH', 'HIGH'), ('3-MEDIUM', NULL), ('4-NOT SPECIFIED', 'LOW'), ('5-LOW', 'LOW'), ('6-DEEP', '1-URGENT'), ('7-LOST', 'GONE'), ('8-SELF', '8-SELF')),
aliases(alias, kind, target) AS (VALUES ('n three', 'nation', 'NATION_3'), ('asia', 'region', 'ASIA'), ('atlantis', 'nation', 'ATLANTIS'), ('x', 'planet', 'MARS'), ('n three', 'nation', 'NATION_4')),
columns_(home, name) AS (VALUES ('part', 'p_size'), ('part', 'o_totalprice'), ('orders', 'o_totalprice')),
contacts(k, phone, mail) AS (VALUES (1, '0912345678', 'a@b.org'), (2, '12', 'a@b.org'), (3, '0912345678', 'none')),
pieces AS (SELECT doc_id AS k, source, lang, length(text) AS size FROM documents UNION ALL SELECT -1, 'src1', 'en', 7 UNION ALL SELECT -2, NULL, 'en', 500 UNION ALL SELECT -3, 'src1', 'xx', 500 UNION ALL SELECT -4, 'src1', 'en', NULL),
marks AS (SELECT doc_id AS k, quality, toxic FROM labels UNION ALL SELECT -77, 1, 0 UNION ALL SELECT -1, 7, 0),
levels(level, lo, hi) AS (VALUES ('low', 1, 10), ('mid', 10, 25), ('odd', 30, 20), ('gap', 40, 50))"""

#: rule, level, the violations' key and where they are.
_RULES = [
    ("PK nation", "error", "k", "nations GROUP BY k HAVING count(*) > 1"),
    ("PK alias", "error", "alias", "aliases GROUP BY alias HAVING count(*) > 1"),
    ("E1 nation of customer", "error", "k", "customers c WHERE NOT EXISTS (SELECT 1 FROM nations n WHERE n.k = c.nation)"),
    ("E1 nation of supplier", "error", "k", "suppliers s WHERE NOT EXISTS (SELECT 1 FROM nations n WHERE n.k = s.nation)"),
    ("E1 region of nation", "error", "k", "nations n WHERE NOT EXISTS (SELECT 1 FROM region r WHERE r.r_regionkey = n.region)"),
    ("E1 customer of order", "error", "k", "bookings b WHERE NOT EXISTS (SELECT 1 FROM customers c WHERE c.k = b.customer)"),
    ("E1 method of order", "error", "k", "bookings b WHERE NOT EXISTS (SELECT 1 FROM methods m WHERE m.code = b.method)"),
    ("E2 attribute outside its table", "error", "name", "columns_ WHERE substr(name, 1, 1) <> substr(home, 1, 1)"),
    ("E3 alias of nothing", "error", "alias", "aliases a WHERE NOT EXISTS (SELECT 1 FROM nations n WHERE a.kind = 'nation' AND n.name = a.target) AND NOT EXISTS (SELECT 1 FROM region r WHERE a.kind = 'region' AND r.r_name = a.target)"),
    ("E3 kind of alias", "error", "alias", "aliases WHERE kind NOT IN ('nation', 'region')"),
    ("E4 label of no document", "error", "k", "marks m WHERE NOT EXISTS (SELECT 1 FROM pieces p WHERE p.k = m.k)"),
    ("E4b label out of range", "error", "k", "marks WHERE quality NOT IN (0, 1) OR toxic NOT IN (0, 1)"),
    ("E5 bounds of level", "error", "level", "levels WHERE lo > hi"),
    ("E6 parent unknown", "error", "code", "methods m WHERE parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM methods p WHERE p.code = m.parent)"),
    ("E6 parent has a parent", "error", "m.code", "methods m JOIN methods p ON p.code = m.parent WHERE p.parent IS NOT NULL AND p.code <> m.code"),
    ("E6 parent is itself", "error", "code", "methods WHERE parent = code"),
    ("E7 phone", "error", "k", "contacts WHERE length(phone) NOT IN (10, 11) OR substr(phone, 1, 1) <> '0'"),
    ("E7 mail", "error", "k", "contacts WHERE NOT contains(mail, '@')"),
    ("E8 name missing", "error", "k", "nations WHERE name IS NULL"),
    ("E8 name not trimmed", "error", "k", "nations WHERE name <> trim(name)"),
    ("E9 price under 0", "error", "k", "bookings WHERE price < 0"),
    ("W1 year out of range", "warning", "k", "bookings WHERE year NOT BETWEEN 1990 AND 2030"),
    ("W2 segment unknown", "warning", "k", "customers WHERE segment NOT IN ('BUILDING', 'FURNITURE', 'MACHINERY', 'AUTOMOBILE', 'HOUSEHOLD')"),
    ("W2 language unknown", "warning", "k", "pieces WHERE lang NOT IN ('en', 'de', 'fr', 'es')"),
    ("W3 text short", "warning", "k", "pieces WHERE size < 20"),
    ("W4 balance far out", "warning", "k", "customers WHERE balance > (SELECT 10 * avg(c_acctbal) FROM customer)"),
    ("W5 segment missing", "warning", "k", "customers WHERE segment IS NULL"),
    ("W5 source missing", "warning", "k", "pieces WHERE source IS NULL"),
    ("W6 text missing", "warning", "k", "pieces WHERE size IS NULL"),
    ("W7 gap between levels", "warning", "l.level", "levels l WHERE l.lo > (SELECT min(lo) FROM levels) AND NOT EXISTS (SELECT 1 FROM levels o WHERE o.hi = l.lo)"),
    ("W8 nation without supplier or customer", "warning", "name", "nations n WHERE NOT EXISTS (SELECT 1 FROM customers c WHERE c.nation = n.k) AND NOT EXISTS (SELECT 1 FROM suppliers s WHERE s.nation = n.k)"),
]
RULES = [r for r, *_ in _RULES]


@query("validate_catalog", f"WITH {_TABLES} " + " UNION ALL ".join(f"SELECT '{rule}' AS rule, '{level}' AS level, CAST({key} AS VARCHAR(99)) AS key FROM {where}" for rule, level, key, where in _RULES))
def validate_catalog(t):
    """All rules over the tables: a scan each for their row rules, one count of keys, one join of references."""
    seeded = lambda df, rows: df.unionByName(t.spark.createDataFrame(rows, df.schema))
    made = lambda rows, schema: t.spark.createDataFrame(rows, schema)
    e, w, known = "error", "warning", "quality IN (0, 1) AND toxic IN (0, 1)"
    nations = seeded(t.nation.selectExpr("n_nationkey AS k", "n_name AS name", "n_regionkey AS region"), [(3, "NATION_3", 0), (90, "NATION_90", 77), (91, " nation x ", 1), (92, None, 1)])
    mean = t.customer.agg(F.avg("c_acctbal")).first()[0] or 0.0
    customers = seeded(t.customer.selectExpr("c_custkey AS k", "c_nationkey AS nation", "c_mktsegment AS segment", "c_acctbal AS balance"), [(-1, 500, "BUILDING", 1.0), (-2, 1, "SPACE", 1.0), (-3, 1, None, 1e9)])
    suppliers = seeded(t.supplier.selectExpr("s_suppkey AS k", "s_nationkey AS nation"), [(-1, 501)])
    orders = t.orders.selectExpr("o_orderkey AS k", "o_custkey AS customer", "o_orderpriority AS method", "year(o_orderdate) AS year", "o_totalprice AS price")
    orders = seeded(orders, [(-1, -99, "1-URGENT", 1997, 10.0), (-2, 1, "9-NONE", 1997, 10.0), (-3, 1, "1-URGENT", 2090, 10.0), (-4, 1, "1-URGENT", 1997, -5.0)])
    methods = made([("HIGH", None), ("LOW", None), ("1-URGENT", "HIGH"), ("2-HIGH", "HIGH"), ("3-MEDIUM", None), ("4-NOT SPECIFIED", "LOW"), ("5-LOW", "LOW"), ("6-DEEP", "1-URGENT"), ("7-LOST", "GONE"), ("8-SELF", "8-SELF")], "code string, parent string")
    aliases = made([("n three", "nation", "NATION_3"), ("asia", "region", "ASIA"), ("atlantis", "nation", "ATLANTIS"), ("x", "planet", "MARS"), ("n three", "nation", "NATION_4")], "alias string, kind string, target string")
    columns = made([("part", "p_size"), ("part", "o_totalprice"), ("orders", "o_totalprice")], "home string, name string")
    contacts = made([(1, "0912345678", "a@b.org"), (2, "12", "a@b.org"), (3, "0912345678", "none")], "k int, phone string, mail string")
    pieces = seeded(t.documents.selectExpr("doc_id AS k", "source", "lang", "length(text) AS size"), [(-1, "src1", "en", 7), (-2, None, "en", 500), (-3, "src1", "xx", 500), (-4, "src1", "en", None)])
    marks = t.labels.selectExpr("doc_id AS k", "cast(quality AS long) AS quality", "cast(toxic AS long) AS toxic")
    marks = seeded(marks, [(-77, 1, 0), (-1, 7, 0)])
    levels = made([("low", 1, 10), ("mid", 10, 25), ("odd", 30, 20), ("gap", 40, 50)], "level string, lo int, hi int")
    lowest = levels.agg(F.min("lo")).first()[0]
    return violations([
        Checked(nations, "k", [("E8 name missing", e, "name IS NULL"), ("E8 name not trimmed", e, "name <> trim(name)")], "PK nation", [Reference("E1 region of nation", e, "region", "'region'")], [("nation", "k", "true"), ("named nation", "name", "true")]),
        Checked(nations, "name", references=[Reference("W8 nation without supplier or customer", w, "k", "'used nation'")]),
        Checked(t.region, "r_regionkey", provides=[("region", "r_regionkey", "true"), ("named region", "r_name", "true")]),
        Checked(customers, "k", [("W2 segment unknown", w, "segment NOT IN ('BUILDING', 'FURNITURE', 'MACHINERY', 'AUTOMOBILE', 'HOUSEHOLD')"), ("W4 balance far out", w, f"balance > 10 * {mean!r}D"), ("W5 segment missing", w, "segment IS NULL")], None, [Reference("E1 nation of customer", e, "nation", "'nation'")], [("customer", "k", "true"), ("used nation", "nation", "true")]),
        Checked(suppliers, "k", references=[Reference("E1 nation of supplier", e, "nation", "'nation'")], provides=[("used nation", "nation", "true")]),
        Checked(orders, "k", [("E9 price under 0", e, "price < 0"), ("W1 year out of range", w, "year NOT BETWEEN 1990 AND 2030")], None, [Reference("E1 customer of order", e, "customer", "'customer'"), Reference("E1 method of order", e, "method", "'method'")]),
        Checked(methods, "code", [("E6 parent is itself", e, "parent = code")], None, [Reference("E6 parent unknown", e, "parent", "'method'"), Reference("E6 parent has a parent", e, "parent", "'child method'", "parent <> code", True)], [("method", "code", "true"), ("child method", "code", "parent IS NOT NULL")]),
        Checked(aliases, "alias", [("E3 kind of alias", e, "kind NOT IN ('nation', 'region')")], "PK alias", [Reference("E3 alias of nothing", e, "target", "'named ' || kind")]),
        Checked(columns, "name", [("E2 attribute outside its table", e, "substr(name, 1, 1) <> substr(home, 1, 1)")]),
        Checked(contacts, "k", [("E7 phone", e, "length(phone) NOT IN (10, 11) OR substr(phone, 1, 1) <> '0'"), ("E7 mail", e, "NOT contains(mail, '@')")]),
        Checked(pieces, "k", [("W2 language unknown", w, "lang NOT IN ('en', 'de', 'fr', 'es')"), ("W3 text short", w, "size < 20"), ("W5 source missing", w, "source IS NULL"), ("W6 text missing", w, "size IS NULL")], provides=[("document", "k", "true")]),
        Checked(marks, "k", [("E4b label out of range", e, f"NOT ({known})")], None, [Reference("E4 label of no document", e, "k", "'document'")]),
        Checked(levels, "level", [("E5 bounds of level", e, "lo > hi")], None, [Reference("W7 gap between levels", w, "lo", "'level end'", f"lo > {lowest}")], [("level end", "hi", "true")]),
    ])
