import json

import pytest

from tessella.functions.chunks import carry_short, split_long
from tessella.functions.dialogue import Candidate, Pick, build_pending, merge_context, merge_pick, pick_choice, register_unclear, substitute, update_context
from tessella.operators.conversation import fold_context, pick_choices
from tessella.plans.dialogue import readings
from tessella.sources.tables import Tables

SF = "/root/testdata/sf0.01"
C = [Candidate("IT1", "Computer science", "chuan"), Candidate("IT2", "Computer engineering", "chuan"), Candidate("ME-1", "Mechanical design", "elitech")]
CARS = [Candidate("TE1", "Kỹ thuật Ô tô", "chuan"), Candidate("TE-E2", "Kỹ thuật Ô tô (CT tiên tiến)", "elitech")]
COHORTS = [Candidate("K71+", "Khoá 71 trở về sau"), Candidate("K70-", "Khoá 70 trở về trước")]
COMPUTING = [Candidate(c, n) for c, n in (("IT1", "Khoa học máy tính"), ("IT2", "Kỹ thuật máy tính"), ("IT-E10", "Khoa học dữ liệu"), ("IT-E15", "An toàn không gian số"), ("IT-E7", "Công nghệ thông tin Global ICT"), ("IT-E6", "Công nghệ thông tin Việt Nhật"), ("IT-EP", "Công nghệ thông tin Việt Pháp"))]


@pytest.mark.parametrize(
    ("message", "candidates", "codes", "stage"),
    [
        ("IT 1 please", C, ["IT1"], 1), ("the me1", C, ["ME-1"], 1), ("IT1 and what does it cost", C, [], None), ("me-1, it2", C, ["IT2", "ME-1"], 1),
        ("all of them", C, ["IT1", "IT2", "ME-1"], 3), ("both please", C[:2], ["IT1", "IT2"], 3), ("the second one", C, ["IT2"], 4), ("last", C, ["ME-1"], 4),
        ("first or second", C, [], None), ("second", C[:1], [], None), ("last", [], [], None), ("cái thứ hai", C, ["IT2"], 4), ("3", C, ["ME-1"], 4), ("I would like to please choose the 1st one", C, [], None),
        ("science", C, ["IT1"], 5), ("computer", C, [], None), ("science fees", C, [], None), ("computer electrical", C, [], None), ("engineering design", C, [], None), ("it", C, [], None),
        ("advanced", C, ["ME-1"], 6), ("hệ chuẩn", C, [], None), ("the standard one", C, [], None), ("", C, [], None), ("hello", C, [], None),
    ],
)
def test_picks_in_order_of_the_cascade(message, candidates, codes, stage):
    assert pick_choice(message, candidates) == Pick(codes, stage)


def test_buttons_cohorts_and_lists_too_long():
    assert pick_choice("anything", C, button="IT2") == Pick(["IT2"], 0) and pick_choice("x", C, button="no") == Pick()
    for message, code in (("K70", "K70-"), ("khoá 69", "K70-"), ("năm 2026", "K71+"), ("72", "K71+"), ("2025", "K70-")):
        assert pick_choice(message, COHORTS, "cohort") == Pick([code], 1 if message == "K70" else 2)
    assert pick_choice("K70 and IELTS", COHORTS, "cohort") == Pick() and pick_choice("khoá 69", COHORTS) == Pick()
    assert pick_choice("tất cả", COMPUTING) == Pick(too_many=True)


#: Labelled answers: what is asked, the candidates, the answer, and the codes that it picks, if it is a pick at all.
LABELLED = [
    ("TE-E2, năm 2024", CARS, ["TE-E2"]), ("cái tiên tiến, so với IT1 luôn", CARS, ["TE-E2"]), ("TE1, học phí bao nhiêu?", CARS, ["TE1"]), ("cả hai năm 2024 nhé", CARS, ["TE1", "TE-E2"]),
    ("cái học bằng tiếng Anh ấy", CARS, ["TE-E2"]), ("Học phí ngành IT1 bao nhiêu?", CARS, []), ("điều kiện nhận học bổng là gì?", CARS, []), ("thôi không cần nữa", CARS, []), ("bỏ qua đi", CARS, []), ("cái kia", CARS, []),
    ("cái nào cũng được", CARS, []), ("ừ", CARS, []), ("Thế điểm chuẩn UET thì sao?", CARS, []), ("em khoá 70, còn IELTS thì sao?", COHORTS, ["K70-"]), ("Khoa học máy tính với Việt Nhật", COMPUTING, ["IT1", "IT-E6"]),
    ("the advanced one, for 2024 please", CARS, ["TE-E2"]), ("TE1, and how much is its tuition?", CARS, ["TE1"]), ("never mind", CARS, []), ("hmm I'm not sure", CARS, []), ("What is the tuition fee for IT1?", CARS, []),
]


def test_labelled_answers_are_never_picked_wrongly():
    """All of them say more than a pick or none, so the router decides; merge_pick then takes its codes."""
    for message, candidates, codes in LABELLED:
        kind = "cohort" if candidates is COHORTS else "program"
        assert pick_choice(message, candidates, kind) == Pick(), message
        asked = build_pending([{"tool": "lookup" if kind == "cohort" else "scores", "args": {"programs": ["x"], "years": [2025]}}], [{"status": "ambiguous", "clarifications": [{"mention": "X", "candidates": [{"code": c.code, "name": c.name, "entity_type": kind} for c in candidates]}]}])
        got = merge_pick(asked, codes, [])
        assert (got is None) == (not codes) and (not codes or got[0]["args"] == ({"programs": ["x"], "years": [2025], "cohort": codes[0]} if kind == "cohort" else {"programs": codes, "years": [2025]}))
    assert pick_choice("TE-E2", CARS).codes == ["TE-E2"] and pick_choice("cái tiên tiến", CARS).codes == ["TE-E2"] and pick_choice("cả hai nhé", CARS).codes == ["TE1", "TE-E2"]


def call(tool, done=None, **args):
    return {"tool": tool, "args": args, "done": done}


def asked(mention, codes, kind="program"):
    return {"status": "ambiguous", "clarifications": [{"mention": mention, "candidates": [{"code": c, "name": c, "entity_type": kind} for c in codes]}]}


OK = {"status": "ok"}


def test_pending_keeps_what_is_found_and_asks_the_first():
    calls = [call("scores", programs=["cs", "me"]), call("fees", programs=["CS", "x"]), call("info", programs=["me"])]
    p = build_pending(calls, [OK, asked("cs", ["A", "B"]), asked("me", ["C"])])
    assert (p["index"], p["mention"], p["field"], [c["done"] for c in p["calls"]]) == (1, "cs", "programs", [OK, None, None]) and build_pending(calls, [OK] * 3) is None
    after = substitute(p, ["A", "B"])
    assert [c["args"]["programs"] for c in after] == [["A", "B", "me"], ["A", "B", "x"], ["me"]] and [c["done"] for c in after] == [None] * 3
    assert substitute(p, ["me"])[0]["args"]["programs"] == ["me"] and calls[0]["args"]["programs"] == ["cs", "me"]
    single = build_pending([call("list", faculty="Điện"), call("org", done=OK, year=1)], [asked("dien", ["E1"], "faculty"), OK])
    assert substitute(single, ["E1"])[0]["args"] == {"faculty": "E1"} and substitute(single, ["E1"])[1]["done"] == OK


def test_a_pick_that_says_more():
    p = build_pending([call("scores", programs=["cs"], years=[2025]), call("info", programs=["z"])], [asked("cs", ["A", "B"]), OK])
    assert merge_pick(p, ["Z"], []) is None and merge_pick(p, [], []) is None
    year = merge_pick(p, ["A"], [call("scores", programs=["cs"], years=[2024])])
    assert year == [call("scores", programs=["A"], years=[2024]), call("info", programs=["z"], years=[2024])]  # info's arguments changed, so it runs again
    more = merge_pick(p, ["A", "A"], [call("scores", programs=["C"]), call("fees", programs=[]), call("search")])
    assert more == [call("scores", programs=["A", "C"], years=[2025]), call("info", OK, programs=["z"]), call("fees", programs=["A"])]
    one = merge_pick(p, ["A", "B"], [call("lookup", year=2023)])
    assert one[2] == call("lookup", year=2023, programs=["A", "B"]) and one[0]["args"]["years"] == [2023]
    cohort = build_pending([call("lookup", certificate="c"), call("search", programs=["q"])], [asked("khoá học", ["K71+", "K70-"], "cohort"), OK])
    assert merge_pick(cohort, ["K70-"], []) == [call("lookup", certificate="c", cohort="K70-"), call("search", OK, programs=["q"])]


def test_context_carries_and_is_kept():
    context = {"programs": ["A"], "faculties": ["F"], "methods": ["M"], "years": [2024, 2025], "cohort": "K70", "last_tool": "scores"}
    assert merge_context([call("scores"), call("lookup", programs=["B"]), call("org", year=1)], True, context) == [call("scores", programs=["A"], methods=["M"], years=[2024, 2025]), call("lookup", programs=["B"]), call("org", year=1, programs=["A"], faculties=["F"])]
    assert merge_context([call("list")], True, context | {"last_tool": "list"})[0]["args"] == {"programs": ["A"], "faculty": "F", "years": [2024, 2025], "method": "M"}
    assert merge_context([call("lookup")], True, context | {"last_tool": "lookup"})[0]["args"] == {"programs": ["A"], "cohort": "K70"} and merge_context([call("scores")], False, context) == [call("scores")]
    done = {"status": "partial", "resolved": [{"entity_type": "program_group", "codes": ["X", "Y"]}, {"entity_type": "method", "codes": list("abcd")}]}
    got = update_context(context | {"pending": {}}, "answered", [call("fees", years=[1999]), call("info", years=[2000])], [{"status": "error"}, done], "ASK")
    assert got == {"programs": ["X", "Y"], "faculties": ["F"], "methods": ["M"], "years": [2000], "cohort": "K70", "last_tool": "info", "last_intent": "ASK", "pending": None}
    assert update_context(context, "refused") == context and update_context(context | {"pending": {"x": 1}}, "cancel")["pending"] is None
    assert update_context(context, "clarify", pending={"x": 1}) == context | {"pending": {"x": 1}, "last_intent": "CLARIFICATION_NEEDED"}
    once, released = register_unclear({"pending": {"retries": 0}})
    assert not released and once["pending"]["retries"] == 1 and register_unclear(once) == ({"pending": None}, True) and register_unclear({}) == ({}, False)


def replayed(rows):
    """The turns of context_update, one after another: one call a turn, one question."""
    picks = {"cái thứ hai": (["P2"], 4), "p e3 nhé": (["P-E3"], 1), "tất cả": (["P1", "P2", "P-E3"], 3)}
    state, asks = {}, None
    for r in rows:
        mine, result = json.loads(r["calls"])[0], json.loads(r["results"])[0]
        mine = {"tool": mine["tool"], "args": mine["args"]}
        how, released, calls, extra = "new", False, [mine], []
        if asks:
            codes, stage = (["P1"], 0) if r["button"] == "P1" else picks.get(r["message"], ([], None))
            old = {"tool": asks[0]["tool"], "args": dict(asks[0]["args"])}
            put = lambda args, new: args | ({"programs": new} if args.get("programs") == ["Mơ hồ"] else {})
            if codes:
                how, calls, extra = f"stage {stage}", [old | {"args": put(old["args"], codes)}, *({"tool": c["tool"], "args": put(c["args"], codes)} for c in asks[1])], asks[1]
            elif r["status"] == "picked":
                how, base = "router", [{"tool": c["tool"], "args": put(dict(c["args"]), ["P2"])} for c in (old, *asks[1])]
                mine["args"] = put(mine["args"], ["P2"])
                merged = False
                for c in base:
                    if "years" in mine["args"]:
                        c["args"]["years"] = mine["args"]["years"]
                    if "methods" in mine["args"] and mine["tool"] == c["tool"] == "scores":
                        c["args"]["methods"] = mine["args"]["methods"]
                    if c["tool"] == mine["tool"] and not merged:
                        merged = True
                        c["args"] = c["args"] | mine["args"] | {"programs": list(dict.fromkeys(c["args"].get("programs", []) + mine["args"].get("programs", [])))}
                if not merged:
                    base.append({"tool": mine["tool"], "args": {"programs": base[0]["args"]["programs"]} | mine["args"]})
                calls, extra = base[:3], asks[1]
            elif r["status"] == "cancel":
                how, calls, asks = "cancel", [], None
            elif r["status"] == "unclear":
                how, calls = "unclear", []
                asks = (*asks[:2], asks[2] + 1)
                if asks[2] == 2:
                    released, asks = True, None
        if how == "new" and r["refused"]:
            how, calls = "refused", []
        elif how == "new" and r["refers"]:
            for k in ("programs", "years") if state.get("last_tool") == mine["tool"] else ("programs",):
                if k not in mine["args"] and state.get(k):
                    mine["args"][k] = state[k]
        if calls:
            if result["status"] == "ambiguous":
                asks, state = (calls[0], calls[1:], 0), state | {"last_intent": "CLARIFICATION_NEEDED"}
            else:
                asks, done = None, [c for i, c in enumerate(calls) if i or result["status"] == "ok"]
                codes = result["resolved"][0]["codes"] if result["status"] == "ok" else []
                years = next((c["args"]["years"] for c in done if c["args"].get("years")), None)
                state = state | {"last_intent": "ASK"} | ({"programs": list(dict.fromkeys(codes))} if 0 < len(set(codes)) <= 3 else {}) | ({"years": years} if years else {}) | ({"last_tool": done[0]["tool"]} if done else {})
        yield r["conv_id"], r["turn"], how, released, calls, dict(state), "mo ho" if asks else None, asks[2] if asks else None


def test_the_fold_equals_a_loop(spark):
    table = readings(Tables(spark, SF))
    by_conv = {}
    for r in sorted(table.collect(), key=lambda r: (r["conv_id"], r["turn"], r["message"] or "")):
        by_conv.setdefault(r["conv_id"], []).append(r.asDict(recursive=True))
    want = [x for rows in by_conv.values() for x in replayed(rows)]
    got = sorted(((r["conv_id"], r["turn"], r["how"], r["released"], json.loads(r["calls"]), json.loads(r["context"]), r["waiting"], r["retries"]) for r in fold_context(table.repartition(7)).collect()), key=lambda r: r[:2])
    assert got == sorted(want, key=lambda r: r[:2])
    assert {"new", "refused", "cancel", "unclear", "router", "stage 0", "stage 1", "stage 3", "stage 4"} <= {w[2] for w in want}


def test_folds_of_nulls_and_empty_tables(spark):
    schema = "conv_id long, turn long, message string, button string, status string, picked array<string>, intent string, refers boolean, refused boolean, calls string, results string, extra string"
    df = spark.createDataFrame([(None, None, None, None, None, None, None, None, None, None, None, "x"), (1, 0, "", None, "picked", [], None, True, True, "[]", "[]", "x"), (1, 0, "", None, "picked", [], None, True, True, "[]", "[]", "x")], schema)
    assert sorted((str(r["conv_id"]), r["how"], r["calls"], r["waiting"]) for r in fold_context(df).collect()) == [("1", "refused", "[]", None)] * 2 + [("None", "new", "[]", None)]
    assert fold_context(df.limit(0)).count() == 0
    answers = spark.createDataFrame([(None, None, None, None), ("all", [], "program", None), ("b", [("B", None, None), ("C", "b", None)], None, None)], "message string, candidates array<struct<code string, name string, group string>>, entity_type string, button string")
    assert sorted((r["codes"], r["stage"], r["too_many"]) for r in pick_choices(answers).collect() if r["codes"]) == [(["B"], 1, False)] and pick_choices(answers.limit(0)).count() == 0


def test_long_text_is_split_without_loss():
    table = "| a | b |\n|---|---|\n" + "".join(f"| {i} | {'x' * 40} |\n" for i in range(120))
    for text in ("word " * 2000, "x" * 6000, "line of text\n" * 500, "- item one\n" * 600, table, "intro\n" * 300 + table + "end\n" * 900, "  lead" + " " * 3000 + "tail"):
        pieces = split_long(text, "[p]")
        assert len(pieces) > 1 and not pieces[0].startswith("[p]")
        bare = pieces[0]
        for x in pieces[1:]:
            assert x.startswith("[p]\n")
            x = x[4:]
            bare += x.removeprefix("| a | b |\n|---|---|\n") if bare.endswith("|\n") else x  # within the table
        assert bare == text
    assert split_long(table)[1].startswith("| a | b |\n|---|---|\n| ") and split_long("short", "[p]") == ["short"] and split_long("") == [""]


def test_carried_sections():
    assert carry_short(["a" * 10, "b" * 300, "c" * 5]) == ["a" * 10 + "\n" + "b" * 300, "c" * 5] and carry_short([]) == []


def test_folded_spans_keep_their_places():
    from tessella.functions.chunks import folded_spans

    for text, want in (("Für THE-thé!", [("Für", "fur"), ("THE", "the"), ("thé", "the")]), ("étude of  the", [("the", "the")]), ("Of the thing", [("Of the", "of the")]), ("Đe la mer", [("Đe la", "de la")]), ("", [])):
        assert [(text[a:z], p) for a, z, p in folded_spans(text, ["of the", "the", "fur", "de la", "la"])] == want
