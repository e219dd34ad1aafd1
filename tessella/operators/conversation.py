"""Conversations folded turn by turn, and answers held against candidates, as stages over tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.dialogue import Candidate, pick_choice, take_turn

_TEXT = ("message", "button", "status", "intent")


def fold_context(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """conv, turn, how, released, calls, context, waiting, retries: a row for each turn, with the state after it.

    `turns` has message, button, status and intent (texts), refers and refused, picked (texts), calls and results (JSON lists; see
    take_turn), and conv_col and turn_col (longs). Turns are dealt by conversation and sorted; a task reads them one after another
    and holds one conversation's state, so a conversation of any length takes no memory for its turns. Turns of equal number
    follow by message and calls; a null conversation is one of its own; null lists are empty; JSON that isn't a list is an error.
    Contexts and calls are JSON with sorted keys.
    """
    texts = [F.coalesce(F.col(c), F.lit("[]")).alias(c) for c in ("calls", "results")]
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), *_TEXT, F.coalesce("refers", F.lit(False)).alias("refers"), F.coalesce("refused", F.lit(False)).alias("refused"), "picked", *texts)
    dealt = rows.repartition("conv").sortWithinPartitions("conv", "turn", "message", "calls")

    def run(batches):
        import pyarrow as pa

        conv, context = object(), {}
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["conv"] != conv:
                    conv, context = r["conv"], {}
                context, done = take_turn(context, r | {"calls": json.loads(r["calls"]), "results": json.loads(r["results"])})
                pending = context.get("pending") or {}
                calls = [{"tool": c["tool"], "args": c["args"]} for c in done["calls"]]
                kept = {k: v for k, v in context.items() if k != "pending" and v is not None}
                out.append((conv, r["turn"], done["how"], done["released"], json.dumps(calls, sort_keys=True, ensure_ascii=False), json.dumps(kept, sort_keys=True, ensure_ascii=False), pending.get("mention"), pending.get("retries")))
            columns = list(zip(*out, strict=True)) if out else [[]] * 8
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [conv_col, turn_col, "how", "released", "calls", "context", "waiting", "retries"])

    return dealt.mapInArrow(run, f"{conv_col} long, {turn_col} long, how string, released boolean, calls string, context string, waiting string, retries int")


def pick_choices(answers: DataFrame) -> DataFrame:
    """`answers` (message, candidates: array of code, name, group; entity_type; button) with codes, stage and too_many. Null messages and candidates are empty ones."""

    @F.pandas_udf("codes array<string>, stage int, too_many boolean")
    def picked(rows):
        import pandas as pd

        out = []
        for message, candidates, kind, button in zip(rows["message"], rows["candidates"], rows["entity_type"], rows["button"], strict=True):
            found = [Candidate(c["code"] or "", c["name"] or "", c["group"] or "") for c in (candidates if candidates is not None else ())]
            p = pick_choice(message or "", found, kind or "program", button)
            out.append((p.codes, p.stage, p.too_many))
        return pd.DataFrame(out, columns=["codes", "stage", "too_many"]).astype({"stage": "Int32"})

    names = ("message", "candidates", "entity_type", "button")
    return answers.withColumn("_pick", picked(F.struct(*names))).select(*answers.columns, "_pick.*")
