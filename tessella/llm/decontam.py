"""Benchmark decontamination by templates: numbers, names and units become placeholders, windows of equal templates, or of equal
words whatever their letter case, are joined by their hash, and what stands in the slots must correspond. Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm._common import dropped, saved

#: Tokens in a window; an item of fewer is one window, from LEAST tokens on. Literal tokens that a window needs. Items without such a
#: window are looked for word for word; of fewer than BRIEF tokens, as the whole of a document.
WINDOW, LEAST, LITERALS, BRIEF = 8, 5, 4, 3
#: Share of an item's windows that must match for the document to be contaminated by it.
COVERAGE = 0.5
#: Altered copies: tokens that diagonals may be apart, tokens of the shortest run that counts, and of a run that is enough by itself.
SHIFT, RUN, LONG = 4, 4, 13
#: Benchmark windows up to which their hashes prefilter documents as one literal set; beyond it every window is joined.
INLINE = 50_000
#: Units, a fixed list: they are placeholders after a number.
UNITS = ("mm", "cm", "dm", "km", "m", "mg", "kg", "g", "t", "ml", "cl", "dl", "l", "s", "ms", "min", "h", "hours", "minutes", "seconds", "days", "weeks", "months", "years",
         "meters", "metres", "miles", "feet", "inches", "pounds", "dollars", "euros", "cents", "percent", "degrees", "usd", "eur", "gbp", "hz", "khz", "mhz", "ghz", "kb", "mb", "gb", "tb", "w", "kw", "mw", "v", "a", "j", "kj", "cal", "kcal")
NUMBER, NAME, UNIT = "#", "@", "%"


def tokens(text: Column) -> Column:
    """The text's tokens as they stand: words of letters, numbers with their points and commas as _ . Marks are dropped."""
    t = F.translate(F.coalesce(text.cast("string"), F.lit("")), "_", " ")
    for _ in range(2):  # twice, as a match takes the digit that the next one would start with
        t = F.regexp_replace(t, r"(\p{Nd})[.,](\p{Nd})", "$1_$2")
    return F.trim(F.regexp_replace(t, r"[^\p{L}\p{Nd}_]+", " "))


def templated(line: Column) -> Column:
    """tokens() with placeholders, token for token: #, @ (a capital and small letters after it), % after #; the rest in lower case."""
    t = F.regexp_replace(line, r"\p{Nd}+(_\p{Nd}+)*", NUMBER)
    t = F.lower(F.regexp_replace(t, r"\p{Lu}\p{Ll}+", NAME))
    return _with_units(t)


def caseless(line: Column) -> Column:
    """The line in lower case, ß as ss: its upper case has no other way back."""
    return F.regexp_replace(F.lower(line), "ß", "ss")


def folded(line: Column) -> Column:
    """templated() without the names, which letter case alone tells: # and %, the rest caseless. What is copied in another case is equal here."""
    return _with_units(caseless(F.regexp_replace(line, r"\p{Nd}+(_\p{Nd}+)*", NUMBER)))


def _with_units(t: Column) -> Column:
    return F.regexp_replace(t, rf"{NUMBER} ({'|'.join(UNITS)})( |$)", f"{NUMBER} {UNIT}$2")


def _is_slot(t: Column) -> Column:
    return t.contains(NUMBER) | t.contains(NAME) | (t == UNIT)


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id, raw, words, folded, size: the items' tokens, caseless, as templates and folded."""
    items = benchmark.where(F.col("item_id").isNotNull()).select("item_id", tokens(F.col("text")).alias("line")).where("line <> ''").dropDuplicates()
    items = items.select("item_id", F.split(caseless(F.col("line")), " ").alias("raw"), F.split(templated(F.col("line")), " ").alias("words"), F.split(folded(F.col("line")), " ").alias("folded"))
    return items.withColumn("size", F.least(F.lit(WINDOW), F.size("words")))


def _item_windows(items: DataFrame) -> DataFrame:
    """item_id, size, at, window, folded, slots, item_windows: the windows of each item that hold LITERALS literal tokens; slots are caseless."""
    rows = items.where(F.size("words") >= LEAST).select("*", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("size"))).alias("at"))
    rows = rows.select("item_id", "size", "at", *(F.slice(c, F.col("at") + 1, F.col("size")).alias(n) for c, n in (("words", "window"), ("folded", "folded"), ("raw", "slots"))))
    rows = rows.where(F.size(F.filter("window", lambda t: ~_is_slot(t))) >= F.least(F.lit(LITERALS), F.col("size") - 1))
    counts = rows.groupBy("item_id").agg(F.countDistinct("size", "at").alias("item_windows"))
    return rows.join(counts, "item_id")


def find_leaks(documents: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, n_windows, item_windows, n_slots, kind: documents that hold an item, word for word or re-parameterised.

    A document holds an item if on one diagonal (places in the document less places in the item) at least `coverage` of
    the item's windows match, by their templates or by their folded words, and what stands in their slots corresponds
    one to one whatever its letter case: an item's value has one counterpart in the document and no two values share one. kind is exact where all values are equal, else
    reparameterised; of several diagonals that with the most windows counts, exact before others, then the first.
    Where no diagonal has enough, the document also holds the item if on diagonals at most SHIFT from one with a window
    as many of the item's tokens match, in runs of RUN at least, as an unbroken copy of that share would have, or LONG
    in one run; the kind is altered then, n_windows counts those diagonals' windows, and slots at a run's edge aren't
    compared, as they may stand for more tokens than one.
    An item without a window of LITERALS literal tokens (short ones, or all numbers and names) is held where half of its
    windows match word for word, whatever their letter case; of fewer than BRIEF tokens, where it is the whole document.
    All windows of all whole texts are looked at. Only places whose first three tokens start some window of the
    benchmark, as a template or folded, get a window hash and a row, if the benchmark is small enough for a literal set; otherwise all places do.
    Null ids take no part, null and empty texts hold nothing; rows of one doc_id are told apart by their text.
    """
    items = _items(benchmark)
    wanted = saved(_item_windows(items), "leak-windows")
    sizes = {r["size"]: r["n"] for r in wanted.groupBy("size").agg(F.count("*").alias("n")).collect()}  # WINDOW - LEAST + 1 rows at most
    texts = documents.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("version"), "text")
    docs = _tokenized(texts, "doc_id", "version")
    hits = None
    for size, n in sorted(sizes.items()):
        places = F.sequence(F.lit(0), F.size("words") - size)
        if n <= INLINE:
            starts = [r[0] for r in _keyed(wanted.where(F.col("size") == size), "window").select(F.xxhash64(*(F.get("key", F.lit(k)) for k in range(3)))).distinct().collect()]
            places = F.filter(places, _starts_in(starts))
        cut = lambda i: F.struct(i.alias("place"), *(F.slice(c, i + 1, F.lit(size)).alias(c) for c in ("words", "folded", "values")))  # noqa: B023, E731
        # Windows are cut before they are exploded, so that no row carries its whole text.
        rows = docs.where(F.size("words") >= size).select("doc_id", "version", F.lit(size).alias("size"), F.explode(F.transform(places, cut)).alias("w")).select("doc_id", "version", "size", "w.*")
        rows = _keyed(rows, "words").select("doc_id", "version", "size", "place", "key", "values", F.xxhash64("key").alias("hash"))
        hits = rows if hits is None else hits.unionByName(rows)
    if hits is None:
        hits = docs.select("doc_id", "version", F.lit(0).alias("size"), F.lit(0).alias("place"), F.col("words").alias("key"), F.col("words").alias("values"), F.lit(0).cast("long").alias("hash")).where("false")
    keys = _keyed(wanted, "window").select("item_id", "size", "at", "item_windows", "window", "slots", "key", F.xxhash64("key").alias("hash"))
    both = hits.alias("d").join(keys.alias("b"), (F.col("d.hash") == F.col("b.hash")) & (F.col("d.size") == F.col("b.size")) & (F.col("d.key") == F.col("b.key")))
    both = both.select("doc_id", "version", "item_id", "item_windows", (F.col("place") - F.col("at")).alias("diagonal"), "at",
        F.transform(F.arrays_zip("window", F.col("slots").alias("i"), F.col("values").alias("v")), lambda z: F.when(_is_slot(z["window"]), F.struct(z["i"].alias("i"), z["v"].alias("v")))).alias("pairs"))
    key = ["doc_id", "version", "item_id", "diagonal"]
    groups = both.groupBy(*key).agg(F.first("item_windows").alias("item_windows"), F.collect_set("at").alias("ats"), F.array_distinct(F.flatten(F.collect_set(F.array_compact("pairs")))).alias("pairs"))
    groups = saved(groups.withColumn("n_windows", F.size("ats").cast("long")), "leak-diagonals")
    found = groups.where(_one_to_one("pairs") & (F.col("n_windows") >= coverage * F.col("item_windows")))
    exact = F.forall("pairs", lambda p: p["i"] == p["v"])
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_windows", exact.alias("exact"), (-F.col("diagonal")).alias("first"), F.size("pairs").cast("long").alias("n_slots"), "item_windows")).alias("best"))
    best = best.select("doc_id", "item_id", F.col("best.n_windows").alias("n_windows"), F.col("best.item_windows").alias("item_windows"), F.col("best.n_slots").alias("n_slots"), F.when(F.col("best.exact"), "exact").otherwise("reparameterised").alias("kind"))
    best = best.unionByName(_altered(texts, items, groups, found, coverage))
    plain = saved(_plain_windows(items, wanted), "leak-plain")
    leaks = saved(best if plain.isEmpty() else best.unionByName(_plain_leaks(docs, plain, coverage)), "leaks")
    dropped(wanted, groups, plain)
    return leaks


def _plain_windows(items: DataFrame, wanted: DataFrame) -> DataFrame:
    """item_id, n, size, at, item_windows, key: the windows of caseless tokens of the items that have none with enough literals."""
    rows = items.join(wanted.select("item_id").distinct(), "item_id", "left_anti")
    rows = rows.select("item_id", F.size("raw").alias("n"), "size", (F.size("raw") - F.col("size") + 1).cast("long").alias("item_windows"), "raw", F.explode(F.sequence(F.lit(0), F.size("raw") - F.col("size"))).alias("at"))
    return rows.select("item_id", "n", "size", "at", "item_windows", F.slice("raw", F.col("at") + 1, F.col("size")).alias("key"))


def _plain_leaks(docs: DataFrame, plain: DataFrame, coverage: float) -> DataFrame:
    """The rows of find_leaks of such items: windows of equal tokens, whatever their letter case, on one diagonal."""
    hits = None
    for r in plain.groupBy("size").agg(F.count("*").alias("n")).collect():  # WINDOW rows at most
        size, of = r["size"], plain.where(F.col("size") == r["size"])
        places = F.sequence(F.lit(0), F.size("values") - size)
        if r["n"] <= INLINE:
            lead = min(3, size)
            starts = [x[0] for x in of.select(F.xxhash64(*(F.get("key", F.lit(k)) for k in range(lead)))).distinct().collect()]
            places = F.filter(places, lambda i: F.xxhash64(*(F.get("values", i + k) for k in range(lead))).isin(starts))  # noqa: B023
        cut = lambda i: F.struct(i.alias("place"), F.slice("values", i + 1, F.lit(size)).alias("key"))  # noqa: B023, E731
        rows = docs.where(F.size("values") >= size).select("doc_id", "version", F.size("values").alias("length"), F.explode(F.transform(places, cut)).alias("w")).select("doc_id", "version", "length", "w.*")
        both = rows.withColumn("hash", F.xxhash64("key")).alias("d").join(of.withColumn("hash", F.xxhash64("key")).alias("b"), (F.col("d.hash") == F.col("b.hash")) & (F.col("d.key") == F.col("b.key")))
        both = both.where((F.col("n") >= BRIEF) | (F.col("n") == F.col("length"))).select("doc_id", "version", "item_id", "item_windows", (F.col("place") - F.col("at")).alias("diagonal"), "at")
        hits = both if hits is None else hits.unionByName(both)
    found = hits.groupBy("doc_id", "version", "item_id", "diagonal").agg(F.first("item_windows").alias("item_windows"), F.countDistinct("at").alias("n_windows")).where(F.col("n_windows") >= coverage * F.col("item_windows"))
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_windows", "item_windows")).alias("best"))
    return best.select("doc_id", "item_id", "best.n_windows", "best.item_windows", F.lit(0).cast("long").alias("n_slots"), F.lit("exact").alias("kind"))


def _tokenized(texts: DataFrame, *kept: str) -> DataFrame:
    """The kept columns with words, folded and values. Exploding one struct keeps the optimizer from copying the expressions to each place that reads them."""
    lines = texts.select(*kept, tokens(F.col("text")).alias("line"))
    arrays = F.struct(F.split(templated(F.col("line")), " ").alias("words"), F.split(folded(F.col("line")), " ").alias("folded"), F.split(caseless(F.col("line")), " ").alias("values"))
    return lines.select(*kept, F.explode(F.array(arrays)).alias("t")).select(*kept, "t.*")


def _one_to_one(pairs: str) -> Column:
    return (F.size(F.array_distinct(F.transform(pairs, lambda p: p["i"]))) == F.size(pairs)) & (F.size(F.array_distinct(F.transform(pairs, lambda p: p["v"]))) == F.size(pairs))


def _altered(texts: DataFrame, items: DataFrame, groups: DataFrame, found: DataFrame, coverage: float) -> DataFrame:
    """The rows of find_leaks of kind altered. Only texts with a matching window are read again."""
    near = Window.partitionBy("doc_id", "version", "item_id").orderBy("diagonal").rangeBetween(-SHIFT, SHIFT)
    tried = groups.withColumn("n_windows", F.size(F.array_distinct(F.flatten(F.collect_list("ats").over(near)))).cast("long")).join(found.select("doc_id", "item_id").distinct(), ["doc_id", "item_id"], "left_anti")
    tried = tried.groupBy("doc_id", "version").agg(F.collect_list(F.struct("item_id", "diagonal", "n_windows", "item_windows")).alias("tried"))
    rows = _tokenized(texts.join(tried, ["doc_id", "version"]), "doc_id", "tried").select("*", F.explode("tried").alias("c")).drop("tried")
    # The document's tokens from SHIFT before the diagonal's start on, so that token j of the item is at j + SHIFT + shift.
    n, at = F.size("i_words"), F.col("c.diagonal") - SHIFT
    part = lambda c: F.transform(F.sequence(F.lit(0), n + (2 * SHIFT - 1)), lambda k: F.get(c, at + k)).alias(c)
    own = items.select("item_id", F.col("words").alias("i_words"), F.col("folded").alias("i_folded"), F.col("raw").alias("i_values"), "size")
    rows = rows.join(own, F.col("c.item_id") == F.col("item_id")).select("doc_id", "c.*", "i_words", "i_folded", "i_values", "size", *(part(c) for c in ("words", "folded", "values")))
    places, shifts = F.sequence(F.lit(0), n - 1), F.sequence(F.lit(0), F.lit(2 * SHIFT))
    same = lambda e, j: (F.get("i_words", j) == F.get("words", j + e)) | (F.get("i_folded", j) == F.get("folded", j + e))
    rows = rows.withColumn("marks", F.transform(shifts, lambda e: F.array_join(F.transform(places, lambda j: F.when(same(e, j), "1").otherwise("0")), "")))
    in_run = lambda m, j: F.exists(F.sequence(F.lit(0), F.lit(RUN - 1)), lambda k: (j >= k) & (m.substr(j - k + 1, F.lit(RUN)) == "1" * RUN))
    rows = rows.withColumn("covered", F.size(F.filter(places, lambda j: F.exists("marks", lambda m: in_run(m, j)))))
    rows = rows.where((F.col("covered") >= F.col("size") - 1 + coverage * (n - F.col("size") + 1)) | F.exists("marks", lambda m: m.contains("1" * LONG)))
    inner = lambda m, j: _is_slot(F.get("i_words", j)) & in_run(m, j) & (F.concat(F.lit("1"), m, F.lit("1")).substr(j + 1, F.lit(3)) == "111")
    pairs = F.transform(shifts, lambda e: F.transform(F.filter(places, lambda j: inner(F.get("marks", e), j)), lambda j: F.struct(F.get("i_values", j).alias("i"), F.get("values", j + e).alias("v"))))
    rows = rows.withColumn("pairs", F.array_distinct(F.flatten(pairs))).where(_one_to_one("pairs"))
    best = rows.groupBy("doc_id", "item_id").agg(F.max(F.struct("covered", "n_windows", (-F.col("diagonal")).alias("first"), F.size("pairs").cast("long").alias("n_slots"), "item_windows")).alias("best"))
    return best.select("doc_id", "item_id", *(F.col(f"best.{c}").alias(c) for c in ("n_windows", "item_windows", "n_slots")), F.lit("altered").alias("kind"))


def _keyed(rows: DataFrame, template: str) -> DataFrame:
    """A row, with `key`, for the template and one for the folded words where they differ. Equal keys of two kinds hold no name, so they're equal in both."""
    return rows.select("*", F.explode(F.array_distinct(F.array(template, "folded"))).alias("key"))


def _starts_in(starts: list[int]):
    start = lambda words, i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).isin(starts)
    return lambda i: start("words", i) | start("folded", i)


def decontaminate(documents: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents, in their own columns, that hold no benchmark item. Rows with a null id stay."""
    leaks = find_leaks(documents, benchmark, **how).select("doc_id").distinct()
    return documents.alias("d").join(leaks.alias("l"), F.col("d.doc_id") == F.col("l.doc_id"), "left_anti")


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _sql_line(text: str) -> str:
    numbers = f"regexp_replace(regexp_replace(replace(coalesce({text}, ''), '_', ' '), '(\\p{{Nd}})[.,](\\p{{Nd}})', '\\1_\\2', 'g'), '(\\p{{Nd}})[.,](\\p{{Nd}})', '\\1_\\2', 'g')"
    return f"trim(regexp_replace({numbers}, '[^\\p{{L}}\\p{{Nd}}_]+', ' ', 'g'))"


def _sql_units(t: str) -> str:
    return f"regexp_replace({t}, '# ({'|'.join(UNITS)})( |$)', '# %\\2', 'g')"


def _sql_caseless(t: str) -> str:
    return f"replace(lower({t}), 'ß', 'ss')"


def _sql_words(name: str, lines: str, key: str) -> str:
    """The rows of `lines` (key, line) with raw, words and folded: caseless tokens, templates, templates without names."""
    numbers = "regexp_replace(line, '\\p{Nd}+(_\\p{Nd}+)*', '#', 'g')"
    named = f"lower(regexp_replace({numbers}, '\\p{{Lu}}\\p{{Ll}}+', '@', 'g'))"
    split = lambda t: f"string_split({t}, ' ')"
    return f"{name} AS (SELECT {key}, {split(_sql_caseless('line'))} AS raw, {split(_sql_units(named))} AS words, {split(_sql_units(_sql_caseless(numbers)))} AS folded FROM {lines})"


_SQL_SLOT = "(contains({0}, '#') OR contains({0}, '@') OR {0} = '%')"
#: All kinds but altered, which no row of the given tables is.
OP9_SQL = f"""
WITH i AS (SELECT DISTINCT item_id, {_sql_line("text")} AS line FROM benchmark WHERE item_id IS NOT NULL AND {_sql_line("text")} <> ''),
{_sql_words("iw", "i", "item_id")},
ip AS (SELECT *, least({WINDOW}, len(words)) AS size FROM iw),
ia AS (SELECT item_id, size, unnest(range(0, len(words) - size + 1)) AS ia, words, folded, raw FROM ip),
ix AS (SELECT item_id, size, ia, len(words) AS n, words[ia + 1:ia + size] AS win, folded[ia + 1:ia + size] AS fold, raw[ia + 1:ia + size] AS vals FROM ia),
ik AS (SELECT * FROM ix WHERE n >= {LEAST} AND len(list_filter(win, lambda t: NOT {_SQL_SLOT.format("t")})) >= least({LITERALS}, size - 1)),
b AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS item_windows FROM ik),
q AS (SELECT *, n - size + 1 AS item_windows FROM ix WHERE item_id NOT IN (SELECT item_id FROM b)),
d AS (SELECT doc_id, {_sql_line("text")} AS line FROM documents WHERE doc_id IS NOT NULL),
{_sql_words("dw", "d", "doc_id")},
ds AS (SELECT size FROM b UNION SELECT size FROM q),
dt AS (SELECT doc_id, len(words) AS n, generate_subscripts(words, 1) - 1 AS place, unnest(words) AS w, unnest(folded) AS f, unnest(raw) AS v FROM dw),
dl AS (SELECT doc_id, n, place, list(w) OVER o AS ws, list(f) OVER o AS fs, list(v) OVER o AS vs FROM dt WINDOW o AS (PARTITION BY doc_id ORDER BY place ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)),
dx AS (SELECT doc_id, size, place, n, ws[1:size] AS win, fs[1:size] AS fold, vs[1:size] AS vals FROM dl, ds WHERE place + size <= n),
m AS (SELECT doc_id, item_id, item_windows, place - ia AS diagonal, ia, b.win, dx.vals AS dv, b.vals AS iv FROM dx JOIN b ON dx.size = b.size AND dx.win = b.win
  UNION ALL SELECT doc_id, item_id, item_windows, place - ia, ia, b.win, dx.vals, b.vals FROM dx JOIN b ON dx.size = b.size AND dx.fold = b.fold WHERE dx.win <> b.win),
n AS (SELECT doc_id, item_id, diagonal, any_value(item_windows) AS item_windows, count(DISTINCT ia) AS n_windows FROM m GROUP BY ALL),
u AS (SELECT doc_id, item_id, diagonal, unnest(win) AS w, unnest(iv) AS i, unnest(dv) AS v FROM m),
p AS (SELECT DISTINCT doc_id, item_id, diagonal, i, v FROM u WHERE {_SQL_SLOT.format("w")}),
c AS (SELECT doc_id, item_id, diagonal, count(*) AS n_slots, count(DISTINCT i) AS ni, count(DISTINCT v) AS nv, bool_and(i = v) AS exact FROM p GROUP BY ALL),
f AS (SELECT n.*, coalesce(n_slots, 0) AS n_slots, coalesce(exact, true) AS exact FROM n LEFT JOIN c USING (doc_id, item_id, diagonal)
  WHERE coalesce(ni = n_slots AND nv = n_slots, true) AND n_windows >= {COVERAGE} * item_windows),
e AS (SELECT doc_id, item_id, place - ia AS diagonal, any_value(item_windows) AS item_windows, count(DISTINCT ia) AS n_windows
  FROM dx JOIN q ON dx.size = q.size AND dx.vals = q.vals WHERE q.n >= {BRIEF} OR q.n = dx.n GROUP BY ALL HAVING n_windows >= {COVERAGE} * any_value(item_windows)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_windows DESC, exact DESC, diagonal) AS k
  FROM (SELECT doc_id, item_id, diagonal, item_windows, n_windows, n_slots, exact FROM f UNION ALL SELECT doc_id, item_id, diagonal, item_windows, n_windows, 0, true FROM e))
SELECT doc_id, item_id, n_windows, item_windows::BIGINT AS item_windows, n_slots::BIGINT AS n_slots, CASE WHEN exact THEN 'exact' ELSE 'reparameterised' END AS kind FROM r WHERE k = 1
"""
