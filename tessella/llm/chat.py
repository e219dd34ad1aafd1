"""Chat formatting: one training string per conversation, with the spans that the loss covers. Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template, fixed: a block is HEAD, role, AFTER_ROLE, turns, END_BLOCK; a turn is its text and END_TURN.
HEAD, AFTER_ROLE, END_TURN, END_BLOCK = "### ", ": ", "</turn>", "\n"
#: Turns whose places are summed in one fold.
PART = 256


def escaped(text: Column) -> Column:
    """Neither HEAD nor END_TURN is left in the result, also not across its ends; unescaped() gives the text back."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit("###"), F.lit("\\#\\#\\#"))
    return F.replace(text, F.lit("</turn>"), F.lit("\\<\\/turn>"))


def escaped_role(role: Column) -> Column:
    """Neither HEAD nor AFTER_ROLE is left: a role may hold any text."""
    for c in "\\#: <":
        role = F.replace(role, F.lit(c), F.lit("\\" + c))
    return role


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans (array of start and length in code points, start from 0) of each conversation.

    Turns are sorted by turn, then role and text; null turns first. Adjacent turns of one role share a block; each turn
    keeps its own END_TURN, so that parse_chats() tells them apart. A null role or text is empty. Rows with a null
    conv_id form one conversation. Repeated rows are turns of their own. Other columns don't matter. A conversation is
    one output row, so its turns meet in one task: its memory is that of its own text.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = conversations.select("conv_id", F.struct(F.col("turn"), role.alias("role"), text.alias("text")).alias("t"))
    # Sorted as they stand, escaped afterwards: escaping changes the order.
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    kept = lambda t: F.struct(escaped_role(t["role"]).alias("role"), escaped(t["text"]).alias("text"), (t["role"] == loss_role).alias("loss"))
    turns = turns.select("conv_id", F.transform("turns", kept).alias("turns"))
    at = lambda i: F.col("turns")[i]
    last = F.size("turns") - 1
    starts = F.filter(F.sequence(F.lit(0), last), lambda i: (i == 0) | (at(i)["role"] != at(F.greatest(i - 1, F.lit(0)))["role"]))
    turns = turns.withColumn("starts", starts)
    after = lambda k: F.coalesce(F.get("starts", k + 1), F.size("turns"))
    block = lambda i, k: F.concat(F.lit(HEAD), at(i)["role"], F.lit(AFTER_ROLE), F.array_join(F.transform(F.slice("turns", i + 1, after(k) - i), lambda t: F.concat(t["text"], F.lit(END_TURN))), ""), F.lit(END_BLOCK))
    # Each turn's place: what stands before its text in its block, its text, what stands after it.
    opens = lambda i: (i == 0) | (at(i)["role"] != at(F.greatest(i - 1, F.lit(0)))["role"])
    closes = lambda i: (i == last) | (at(i)["role"] != at(F.least(i + 1, last))["role"])
    place = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(
        F.when(opens(i), F.length(at(i)["role"]) + len(HEAD + AFTER_ROLE)).otherwise(0).cast("long").alias("before"),
        F.length(at(i)["text"]).cast("long").alias("length"),
        (F.lit(len(END_TURN)) + F.when(closes(i), len(END_BLOCK)).otherwise(0)).cast("long").alias("after"),
        at(i)["loss"].alias("loss")))
    turns = turns.select("conv_id", F.array_join(F.transform("starts", block), "").alias("formatted"), place.alias("place"))
    return turns.select("conv_id", "formatted", _spans(F.col("place")).alias("loss_spans"))


def _spans(place: Column) -> Column:
    """start and length of the places under the loss. Starts are summed part by part, since a fold copies what it has gathered at each step."""
    size = lambda p: p["before"] + p["length"] + p["after"]
    zero, none = F.lit(0).cast("long"), lambda kind: F.from_json(F.lit("[]"), f"array<{kind}>")
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(place) - 1) / PART).cast("int")), lambda k: F.slice(place, k * PART + 1, PART))
    starts = F.aggregate(parts, F.struct(zero.alias("at"), none("bigint").alias("starts")), lambda a, c: F.struct(
        F.aggregate(c, a["at"], lambda n, p: n + size(p)).alias("at"), F.concat(a["starts"], F.array(a["at"])).alias("starts")), lambda a: a["starts"])
    within = lambda c, start: F.aggregate(c, F.struct(start.alias("at"), none("struct<start:bigint,length:bigint>").alias("spans")), lambda a, p: F.struct(
        (a["at"] + size(p)).alias("at"),
        F.when(p["loss"], F.concat(a["spans"], F.array(F.struct((a["at"] + p["before"]).alias("start"), p["length"].alias("length"))))).otherwise(a["spans"]).alias("spans")), lambda a: a["spans"])
    return F.flatten(F.zip_with(parts, starts, within))


def parse_chats(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of role and text), loss_text, read from the columns of format_chats() alone."""
    blocks = (lambda parts: F.slice(parts, 2, F.size(parts) - 1))(F.split("formatted", HEAD))
    role = lambda b: F.substring_index(b, AFTER_ROLE, 1)
    body = lambda b: F.substr(b, F.length(role(b)) + 1 + len(AFTER_ROLE))
    texts = lambda b: (lambda parts: F.slice(parts, 1, F.size(parts) - 1))(F.split(body(b), END_TURN))
    turns = F.flatten(F.transform(blocks, lambda b: F.transform(texts(b), lambda t: F.struct(unescaped(role(b)).alias("role"), unescaped(t).alias("text")))))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return formatted.select("conv_id", turns.alias("turns"), loss.alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


#: The text of both turns of the conversation that op1's contract adds.
PLANTED = r"\### Assistant: </turn> ok"


def op1_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    turn = lambda k, role: F.struct(F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(PLANTED).alias("text"))
    planted = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.explode(F.array(turn(0, "user"), turn(1, "assistant"))).alias("t")).select("conv_id", "t.*")
    rows = rows.unionByName(planted)
    read = parse_chats(format_chats(rows))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars")


_ESCAPED = "replace(replace(replace({0}, '\\', '\\\\'), '###', '\\#\\#\\#'), '</turn>', '\\<\\/turn>')"
OP1_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
placed AS (
  SELECT *, coalesce(lag(role) OVER w <> role, true) AS opens, {_ESCAPED.format("text")} AS kept,
    replace(replace(replace(replace(replace(role, '\\', '\\\\'), '#', '\\#'), ':', '\\:'), ' ', '\\ '), '<', '\\<') AS kept_role
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(kept) + 7 + CASE WHEN opens THEN length(kept_role) + 7 ELSE 0 END)::BIGINT AS formatted_chars
FROM placed GROUP BY conv_id
"""
