"""Conversation state over the ordered turns of each conversation: context that carries, counters that reset, guards of calls."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.operators.conversation import fold_context, pick_choices
from tessella.plans import dual, query

#: What stands for a router's reading of a turn: its tool, programmes, faculty and year, and whether it refers to what was said.
_TURNS = """SELECT conv_id, turn, CASE WHEN turn % 5 < 3 THEN 'scores' ELSE 'fees' END AS tool, CASE WHEN turn % 4 = 0 THEN ['p' || turn] WHEN turn % 4 = 3 THEN ['p' || turn, 'q' || turn] END AS programs,
  CASE WHEN turn % 6 = 1 THEN 'f' || turn END AS faculty, CASE WHEN turn % 3 = 0 THEN 2000 + turn END AS year, turn % 7 <> 5 AS refers FROM conversations"""


@query("carry_forward", f"""WITH t AS ({_TURNS}), c AS (SELECT *, last_value(programs IGNORE NULLS) OVER before AS p, last_value(faculty IGNORE NULLS) OVER before AS f, last_value(year IGNORE NULLS) OVER same AS y FROM t
  WINDOW before AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), same AS (PARTITION BY conv_id, tool ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT conv_id, turn, tool, coalesce(programs, CASE WHEN refers THEN p END) AS programs, coalesce(faculty, CASE WHEN refers THEN f END) AS faculty, CAST(coalesce(year, CASE WHEN refers THEN y END) AS INTEGER) AS year FROM c)
SELECT *, CASE WHEN len(programs) = 1 THEN programs[1] END AS program FROM m""")
def carry_forward(t):
    """What a turn leaves open is filled if it refers back: programmes and faculty from any turn before, the year only from one of the
    same tool. What it states is never overwritten; a single-valued parameter comes from a list of one element only."""
    n = F.col("turn")
    rows = t.conversations.select("conv_id", "turn", F.when(n % 5 < 3, "scores").otherwise("fees").alias("tool"), F.when(n % 4 == 0, F.array(F.concat(F.lit("p"), n))).when(n % 4 == 3, F.array(F.concat(F.lit("p"), n), F.concat(F.lit("q"), n))).alias("programs"),
        F.when(n % 6 == 1, F.concat(F.lit("f"), n)).alias("faculty"), F.when(n % 3 == 0, (n + 2000).cast("int")).alias("year"), (n % 7 != 5).alias("refers"))
    before = lambda *by: Window.partitionBy("conv_id", *by).orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    filled = lambda c, *by: F.coalesce(c, F.when(F.col("refers"), F.last(c, ignorenulls=True).over(before(*by)))).alias(c)
    rows = rows.select("conv_id", "turn", "tool", filled("programs"), filled("faculty"), filled("year", "tool"))
    return rows.withColumn("program", F.when(F.size("programs") == 1, F.col("programs")[0]))


@query("context_fold", "SELECT conv_id, turn, list_sort(list_distinct(list(role) FILTER (WHERE role IS NOT NULL) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))) AS seen FROM conversations")
def context_fold(t):
    """The roles seen so far after each turn."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return t.conversations.select("conv_id", "turn", F.sort_array(F.collect_set("role").over(w)).alias("seen"))


_UNCLEAR = "length(text) < 200"
_RUNS = f"SELECT conv_id, turn, {_UNCLEAR} AS unclear, sum(CASE WHEN {_UNCLEAR} THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS grp FROM {{conversations}}"
dual("streak_reset", f"WITH f AS ({_RUNS}), s AS (SELECT conv_id, turn, unclear, sum(CASE WHEN unclear THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, grp ORDER BY turn ROWS UNBOUNDED PRECEDING) AS s FROM f) SELECT conv_id, turn, CAST(CASE WHEN NOT unclear THEN 0 WHEN s % 2 = 0 THEN 0 ELSE 1 END AS INTEGER) AS streak, unclear AND s % 2 = 0 AS released FROM s")

#: A turn's calls: as many as its text has lines, up to five; a message that starts with a refused word has none.
_LINES = "len(string_split(text, chr(10)))"


@query("guard_calls", f"""WITH c AS (SELECT conv_id, turn, role, text, least(5, {_LINES}) AS asked, regexp_matches(lower(text), '^(no|nein|non)\\b') AS refused, coalesce(lag(text LIKE '%?') OVER (PARTITION BY conv_id ORDER BY turn), false) AS pending, length(text) < 40 AS short FROM conversations)
SELECT conv_id, turn, CAST(CASE WHEN role <> 'user' OR refused THEN 0 ELSE least(3, asked) END AS INTEGER) AS calls, role = 'user' AND short AND pending AND NOT refused AS is_pick, role = 'user' AND NOT refused AND asked > 3 AS cut FROM c""")
def guard_calls(t):
    """A refusal has no calls; three calls at most; a pick only where a question is pending."""
    text, refused = F.col("text"), F.lower("text").rlike("^(no|nein|non)\\b")
    asked = F.least(F.lit(5), F.size(F.split(text, "\n")))
    pending = F.coalesce(F.lag(text.endswith("?")).over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(False))
    user = F.col("role") == "user"
    rows = t.conversations.select("conv_id", "turn", user.alias("user"), asked.alias("asked"), refused.alias("refused"), pending.alias("pending"), (F.length(text) < 40).alias("short"))
    return rows.select("conv_id", "turn", F.when(~F.col("user") | F.col("refused"), 0).otherwise(F.least(F.lit(3), "asked")).alias("calls"), F.expr("user AND short AND pending AND NOT refused").alias("is_pick"), F.expr("user AND NOT refused AND asked > 3").alias("cut"))


def readings(t):
    """What stands for a router's reading of each turn and its tools' results, from the turn's number and text alone."""
    n, size = F.col("turn"), F.length(F.coalesce("text", F.lit("")))
    kind = (size + n) % 8
    code = lambda k: F.concat(F.lit("P"), (k % 5).cast("string"))
    mention = F.when(kind == 0, F.lit("Mơ hồ")).when(kind.isin(2, 6), F.lit(None)).otherwise(code(size))
    years = F.when(size % 4 == 0, F.array((size % 3 + 2023).cast("int")))
    args = F.struct(F.when(mention.isNotNull(), F.array(mention)).alias("programs"), years.alias("years"), F.when(n % 6 == 1, F.array(F.lit("M1"))).alias("methods"))
    tool = F.when(size % 3 == 0, "scores").when(size % 3 == 1, "fees").otherwise("info")
    candidates = F.array(*[F.struct(F.lit(c).alias("code"), F.lit(x).alias("name"), F.lit(g).alias("group"), F.lit("program").alias("entity_type")) for c, x, g in (("P1", "Cơ khí ô tô", "chuan"), ("P2", "Cơ khí tàu", "elitech"), ("P-E3", "Điện", "elitech"))])
    asked = F.struct(F.lit("ambiguous").alias("status"), F.array(F.struct(F.lit("mo ho").alias("mention"), candidates.alias("candidates"))).alias("clarifications"), F.lit(None).cast("array<struct<entity_type: string, codes: array<string>>>").alias("resolved"))
    resolved = F.array(F.struct(F.lit("program").alias("entity_type"), F.array(code(size), *[F.when(kind == 7, code(size + i)) for i in range(1, 4)]).alias("codes")))
    plain = F.struct(F.when(kind == 4, "error").otherwise("ok").alias("status"), F.lit(None).cast(t.spark.range(0).select(F.array(F.struct(F.lit("").alias("mention"), candidates.alias("candidates"))).alias("x")).schema["x"].dataType).alias("clarifications"), F.transform(resolved, lambda r: F.struct(r["entity_type"].alias("entity_type"), F.filter(r["codes"], lambda c: c.isNotNull()).alias("codes"))).alias("resolved"))
    message = F.when(size % 5 == 0, "cái thứ hai").when(size % 5 == 1, "p e3 nhé").when(size % 5 == 2, "điện và gì nữa").when(size % 5 == 3, "tất cả").otherwise(F.col("text"))
    return t.conversations.select(
        "conv_id", "turn", message.alias("message"), F.when(size % 11 == 0, "P1").alias("button"),
        F.when(size % 5 == 2, F.when(n % 3 == 0, "picked").when(n % 3 == 1, "unclear").otherwise("cancel")).alias("status"), F.array(F.lit("P2")).alias("picked"), F.lit("ASK").alias("intent"),
        (kind != 5).alias("refers"), (kind == 3).alias("refused"),
        F.to_json(F.array(F.struct(tool.alias("tool"), args.alias("args")))).alias("calls"), F.to_json(F.array(F.when(kind == 0, asked).otherwise(plain))).alias("results"),
    )


@query("context_update")
def context_update(t):
    """The state of every conversation after each turn."""
    return fold_context(readings(t))


@query("pick_cascade", """WITH l AS (SELECT DISTINCT l_orderkey, l_partkey, p_name FROM lineitem JOIN part ON p_partkey = l_partkey),
o AS (SELECT l_orderkey, list('P' || l_partkey ORDER BY l_partkey) AS codes, list(string_split(p_name, ' ') ORDER BY l_partkey) AS names FROM l GROUP BY 1),
p AS (SELECT l_orderkey, codes, names, len(codes) AS n, l_orderkey % 8 AS k, len(list_filter(names[1], lambda w: NOT list_contains(flatten(names[2:]), w))) > 0 AS own FROM o)
SELECT l_orderkey, CASE WHEN k = 0 AND n >= 2 THEN [codes[2]] WHEN k = 1 THEN [codes[n]] WHEN k = 2 AND n <= 3 THEN codes WHEN k = 3 THEN [codes[n]] WHEN k = 4 AND own THEN [codes[1]] WHEN k = 7 AND n >= 2 THEN [codes[1], codes[2]] ELSE [] END AS codes,
  CASE WHEN k = 0 AND n >= 2 THEN 4 WHEN k = 1 THEN 1 WHEN k = 2 AND n <= 3 THEN 3 WHEN k = 3 THEN 4 WHEN k = 4 AND own THEN 5 WHEN k = 7 AND n >= 2 THEN 1 END AS stage, k = 2 AND n > 3 AS too_many FROM p""")
def pick_cascade(t):
    """An answer to a list of each order's parts: by place, code, all, word of a name; answers that say more, name two places or too many pick nothing."""
    lines = t.lineitem.select("l_orderkey", "l_partkey").distinct().join(t.part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    part = F.struct("l_partkey", F.concat(F.lit("P"), "l_partkey").alias("code"), F.col("p_name").alias("name"), F.lit("").alias("group"))
    lists = lines.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(part)), lambda p: F.struct(p["code"].alias("code"), p["name"].alias("name"), p["group"].alias("group"))).alias("candidates"))
    k, at = F.col("l_orderkey") % 8, lambda i: F.try_element_at("candidates", F.lit(i))
    two = F.concat(at(2)["code"], F.lit(" với "), at(1)["code"])
    message = F.when(k == 0, "The second one, please").when(k == 1, F.concat(F.lit("p "), F.substr(at(-1)["code"], F.lit(2)))).when(k == 2, "ALL of them").when(k == 3, "cái cuối cùng nhé").when(k == 4, at(1)["name"]).when(k == 5, "first or last").when(k == 6, F.concat(at(1)["code"], F.lit(" and what does it cost"))).otherwise(two)
    return pick_choices(lists.withColumns({"message": message, "entity_type": F.lit("program"), "button": F.lit(None).cast("string")})).select("l_orderkey", "codes", "stage", "too_many")
