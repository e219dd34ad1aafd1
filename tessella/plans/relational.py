"""Scans, filters, joins, aggregates, windows, top-k and set operations over the driver's tables."""

from tessella.plans import dual

# Scans and sinks
dual("scan_parquet", "SELECT p_partkey, p_name, p_brand, p_size FROM {part}")
dual("stable_id", "SELECT doc_id, sha256(source || '::' || CAST(doc_id AS VARCHAR)) AS stable_id FROM documents".replace("documents", "{documents}"), "SELECT doc_id, sha2(source || '::' || CAST(doc_id AS STRING), 256) AS stable_id FROM {documents}")

# Filters and projections
dual("filter_in", "SELECT l_orderkey, l_linenumber, l_quantity FROM {lineitem} WHERE l_returnflag IN ('A', 'R') AND l_linenumber IN (1, 2)")
dual("filter_optional", "SELECT c_custkey, c_name, c_acctbal FROM {customer} WHERE (NULL IS NULL OR c_mktsegment = NULL) AND ('BUILDING' IS NULL OR c_mktsegment = 'BUILDING')")
dual("list_contains", "SELECT p_partkey, p_type FROM {part} WHERE list_contains(string_split(p_type, ' '), upper('steel'))", "SELECT p_partkey, p_type FROM {part} WHERE array_contains(split(p_type, ' '), upper('steel'))")
dual("filter_range", "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice BETWEEN 50000 AND 150000")
dual("filter_notnull", "SELECT d.doc_id, l.quality FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL")
dual("latest_period", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year FROM {orders} WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM {orders})")
dual("filter_nested_bool", "SELECT doc_id FROM {documents} WHERE (lang <> 'en' OR doc_id % 4 IN (1, 2)) AND (source = 'src1' OR source = 'src2' OR n_chars < 500) AND lang IN ('en', 'de', 'fr')")
dual("text_match", "SELECT doc_id FROM {documents} WHERE (list_contains(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), 'the') AND list_contains(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), 'with')) OR list_contains(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), 'les')".replace("{L}", "L").replace("{N}", "N"),
     "WITH d AS (SELECT doc_id, split(lower(text), '[^\\\\pL\\\\pN]+') AS w FROM {documents}) SELECT doc_id FROM d WHERE exists(array(array('the', 'with'), array('les')), p -> forall(p, t -> array_contains(w, t)))")
dual("phrase_contains", "SELECT doc_id FROM {documents} WHERE contains(' ' || lower(text) || ' ', ' of the ')")
dual("coalesce_default", "SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END, ''), 'all') AS lang FROM {documents}")

# Joins
dual("star_join", "SELECT o_orderkey, c_name, n_name FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey")
dual("star_join_2hop", "SELECT o_orderkey, n_name, r_name FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey")
dual("left_join", "SELECT c_custkey, o_orderkey FROM {customer} LEFT JOIN {orders} ON o_custkey = c_custkey AND o_totalprice > 200000")
dual("anti_join", "SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')")
dual("semi_join", "SELECT c_custkey FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '2-HIGH')")
_RANGES = "(VALUES (1, 10.0, 'low'), (10, 25.0, 'mid'), (25, 40.0, 'high'), (40, NULL, 'top')) AS r(lo, hi, level)"
dual("range_lookup", f"SELECT p_partkey, level FROM {{part}} JOIN {_RANGES} ON p_size >= lo AND (hi IS NULL OR p_size <= hi)")
dual("contains_join", "SELECT p_partkey, word FROM {part} JOIN (VALUES ('STEEL'), ('BRASS'), ('TIN')) AS w(word) ON contains(upper(p_type), word)")
dual("match_or_all", "WITH m AS (SELECT p_partkey, p_size = 999 AS hit FROM {part}), a AS (SELECT count(*) FILTER (WHERE hit) AS n FROM m) SELECT p_partkey, n > 0 AS matched FROM m, a WHERE hit OR n = 0")
dual("bridge_join", "SELECT o_orderkey, p_partkey, p_brand FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey WHERE o_totalprice > 250000")
dual("expand_parent", "WITH m AS (SELECT n_nationkey AS code, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_nationkey - n_nationkey % 5 END AS parent FROM {nation}) SELECT a.code AS asked, coalesce(b.code, a.code) AS code FROM m a LEFT JOIN m b ON b.parent = a.code")
dual("rollup_parent", "WITH m AS (SELECT n_nationkey AS code, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_nationkey - n_nationkey % 5 END AS parent FROM {nation}) SELECT coalesce(parent, code) AS root, count(*) AS n FROM {customer} JOIN m ON c_nationkey = code GROUP BY 1")
_STRICT = "SELECT c.c_custkey, coalesce(n.n_name, {0}) AS n_name FROM {customer} c LEFT JOIN {nation} n ON c.c_nationkey = n.n_nationkey"
dual("lookup_strict", _STRICT.replace("{0}", "error('unknown nation')"), _STRICT.replace("{0}", "raise_error('unknown nation')"))
dual("latest_per_key", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM {orders}) t WHERE k = 1")

# Aggregates
dual("group_stats", "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority, count(*) AS n, min(CAST(o_totalprice AS DECIMAL(15,2))) AS lowest, max(CAST(o_totalprice AS DECIMAL(15,2))) AS highest FROM {orders} GROUP BY 1, 2")
dual("group_totals", "SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total FROM {lineitem} GROUP BY 1")
dual("truncation_flag", "WITH g AS (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS total, sum(least(n, 3)) < sum(n) AS truncated FROM g")
dual("members_array", "SELECT n_nationkey, coalesce(list(c_custkey ORDER BY c_custkey) FILTER (WHERE c_custkey IS NOT NULL), []) AS members FROM {nation} LEFT JOIN {customer} ON c_nationkey = n_nationkey AND c_acctbal > 5000 GROUP BY 1",
     "SELECT n_nationkey, sort_array(collect_list(c_custkey)) AS members FROM {nation} LEFT JOIN {customer} ON c_nationkey = n_nationkey AND c_acctbal > 5000 GROUP BY 1")
dual("unit_stats", "SELECT p_brand AS unit, count(*) AS n, min(p_size) AS lowest, max(p_size) AS highest, list(DISTINCT p_type ORDER BY p_type) AS codes FROM {part} GROUP BY 1", "SELECT p_brand AS unit, count(*) AS n, min(p_size) AS lowest, max(p_size) AS highest, sort_array(collect_set(p_type)) AS codes FROM {part} GROUP BY 1")
dual("coverage_years", "SELECT o_orderpriority, list(DISTINCT CAST(year(o_orderdate) AS INTEGER) ORDER BY CAST(year(o_orderdate) AS INTEGER)) AS years FROM {orders} GROUP BY 1", "SELECT o_orderpriority, sort_array(collect_set(year(o_orderdate))) AS years FROM {orders} GROUP BY 1")
dual("pk_duplicates", "SELECT conv_id % 7 AS k, role, count(*) AS n FROM {conversations} GROUP BY 1, 2 HAVING count(*) > 1")
dual("coverage_gaps", "WITH y AS (SELECT DISTINCT c_mktsegment AS s, c_nationkey AS k FROM {customer}), g AS (SELECT s, n_nationkey AS k FROM (SELECT DISTINCT s FROM y) a CROSS JOIN {nation}) SELECT g.s, count(*) AS missing, count(*) = (SELECT count(*) FROM {nation}) AS whole FROM g LEFT JOIN y ON g.s = y.s AND g.k = y.k WHERE y.s IS NULL GROUP BY 1")
dual("mode_range", "WITH c AS (SELECT o_custkey, day(o_orderdate) AS v, count(*) AS n FROM {orders} GROUP BY 1, 2), m AS (SELECT o_custkey, v FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, v) AS k FROM c) t WHERE k = 1) SELECT c.o_custkey, CAST(min(c.v) AS INTEGER) AS lo, CAST(max(c.v) AS INTEGER) AS hi FROM c JOIN m ON c.o_custkey = m.o_custkey WHERE abs(c.v - m.v) <= 2 GROUP BY 1")

# Windows
dual("topk_quota", "SELECT year, total, c, rnk FROM (SELECT year, total, c, CAST(rank() OVER (PARTITION BY year ORDER BY total DESC) AS INTEGER) AS rnk FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_custkey AS c, count(*) AS total FROM {orders} GROUP BY 1, 2) a) b WHERE rnk <= 3")
dual("period_delta", "WITH m AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(max(o_totalprice) AS DECIMAL(15,2)) AS v FROM {orders} GROUP BY 1, 2) SELECT * FROM (SELECT o_custkey, lag(y) OVER (PARTITION BY o_custkey ORDER BY y) AS y0, y AS y1, v - lag(v) OVER (PARTITION BY o_custkey ORDER BY y) AS diff FROM m) t WHERE y0 IS NOT NULL")
dual("total_delta", "WITH t AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n FROM {orders} GROUP BY 1) SELECT y, n - lag(n) OVER (ORDER BY y) AS diff FROM t")
dual("last_turns", "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM {conversations}) t WHERE k <= 6")
dual("interleave", "WITH r AS (SELECT o_orderpriority AS p, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS k FROM {orders}) SELECT p, o_orderkey, CAST(row_number() OVER (ORDER BY k, p) AS INTEGER) AS place FROM r WHERE k <= 4")

# Order and sets
dual("order_by_list", "SELECT n_nationkey, CAST(row_number() OVER (ORDER BY CASE n_nationkey WHEN 7 THEN 1 WHEN 3 THEN 2 WHEN 11 THEN 3 ELSE 4 END, n_nationkey) AS INTEGER) AS place FROM {nation}")
dual("union_all", "SELECT c_custkey AS k, 'customer' AS kind FROM {customer} UNION ALL SELECT s_suppkey, 'supplier' FROM {supplier}")
dual("sym_diff", "SELECT k, 'only_left' AS side FROM (SELECT c_nationkey AS k FROM {customer} EXCEPT SELECT s_nationkey FROM {supplier}) a UNION ALL SELECT k, 'only_right' FROM (SELECT s_nationkey AS k FROM {supplier} EXCEPT SELECT c_nationkey FROM {customer}) b")
dual("arrays_overlap", "SELECT p_partkey FROM {part} WHERE list_has_any(string_split(p_type, ' '), ['STEEL', 'SMALL'])", "SELECT p_partkey FROM {part} WHERE arrays_overlap(split(p_type, ' '), array('STEEL', 'SMALL'))")

# Validation rules
dual("fk_orphans", "SELECT doc_id FROM {labels} l WHERE NOT EXISTS (SELECT 1 FROM {documents} d WHERE d.doc_id = l.doc_id)")
dual("vocab_violations", "SELECT doc_id, lang FROM {documents} WHERE lang NOT IN ('en', 'de') OR lang IS NULL")
dual("regex_violations", "SELECT page_id FROM {pages} WHERE NOT regexp_matches(url, '^https://[a-z0-9.-]+/')", "SELECT page_id FROM {pages} WHERE NOT url RLIKE '^https://[a-z0-9.-]+/'")
dual("length_outliers", "SELECT doc_id, CASE WHEN length(text) < 80 THEN 'short' ELSE 'long' END AS kind FROM {documents} WHERE length(text) NOT BETWEEN 80 AND 2500")
dual("manifest_drift", "WITH a AS (SELECT source, count(*) AS n FROM {documents} GROUP BY 1), m AS (SELECT source, count(*) AS n FROM {documents} WHERE doc_id % 50 <> 0 GROUP BY 1) SELECT a.source, a.n - coalesce(m.n, 0) AS drift FROM a LEFT JOIN m ON a.source = m.source WHERE a.n <> coalesce(m.n, 0)")

# Retrieval
_Q = "(SELECT vec_id AS qid, embedding AS q FROM {embeddings} WHERE vec_id = 0)"
_COS = "round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 6)"
_COSS = "round(aggregate(zip_with(embedding, q, (a, b) -> double(a) * double(b)), 0D, (s, x) -> s + x) / sqrt(aggregate(embedding, 0D, (s, x) -> s + double(x) * double(x)) * aggregate(q, 0D, (s, x) -> s + double(x) * double(x))), 6)"
_S = lambda cos, where="true": f"(SELECT vec_id, label, {cos} AS score FROM {{embeddings}} CROSS JOIN {_Q} z WHERE vec_id <> qid AND {where})"
for _name, _where in (("vector_topk", "true"), ("vector_topk_filtered", "label IN (1, 2, 3)")):
    _t = "SELECT vec_id, score FROM {0} s ORDER BY score DESC, vec_id LIMIT 10"
    dual(_name, _t.format(_S(_COS, _where)), _t.format(_S(_COSS, _where)))
_RRF = """WITH s AS {0}, a AS (SELECT vec_id, row_number() OVER (ORDER BY score DESC, vec_id) AS k FROM s), b AS (SELECT vec_id, row_number() OVER (ORDER BY score DESC, vec_id) AS k FROM s WHERE {1}),
u AS (SELECT vec_id, k FROM a WHERE k <= 20 UNION ALL SELECT vec_id, k FROM b WHERE k <= 20)
SELECT vec_id, rrf FROM (SELECT vec_id, round(sum(1e0 / (60 + k)), 8) AS rrf FROM u GROUP BY 1) f ORDER BY rrf DESC, vec_id LIMIT 5"""
for _name, _where in (("rrf_general", "label % 2 = 0"), ("rrf_boost", "label < 3"), ("rrf_fusion", "vec_id % 3 = 0")):
    dual(_name, _RRF.format(_S(_COS), _where), _RRF.format(_S(_COSS), _where))
_GATE = "SELECT max(score) AS top, CASE WHEN max(score) < 0.4 THEN 'LOW_RETRIEVAL_CONFIDENCE' ELSE 'ok' END AS status FROM {0} s"
dual("confidence_gate", _GATE.format(_S(_COS)), _GATE.format(_S(_COSS)))
_CONF = "SELECT count(DISTINCT label) > 1 AS conflict FROM (SELECT label FROM {0} s ORDER BY score DESC, vec_id LIMIT 5) t"
dual("conflict_flag", _CONF.format(_S(_COS)), _CONF.format(_S(_COSS)))
