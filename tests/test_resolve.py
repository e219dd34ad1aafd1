"""The cascade of entity resolution on a small catalogue."""

import random

from tessella.functions.text import indel_ratio
from tessella.operators.resolve import resolve



def best_run(query, key):
    """The best ratio with the key, or with a run of its words that is at most one word shorter or longer than a query of several."""
    w, n = key.split(" "), query.count(" ") + 1
    pieces = {key} | {" ".join(w[i:j]) for i in range(len(w)) for j in range(i + 1, len(w) + 1) if abs(j - i - n) < 2 and 1 < n < len(w)}
    return max(indel_ratio(query, p) for p in pieces)


ENTRIES = [
    ("IT1", "program", "IT1", "unique", "code"), ("Computer Science", "program", "IT1", "unique", "name"), ("CS", "program", "IT1", "unique", "abbrev"),
    ("IT2", "program", "IT2", "unique", "code"), ("Computer Engineering", "program", "IT2", "unique", "name"),
    ("Old Metallurgy", "program", "MT9", "unique", "name"), ("Automotive", "program", "TE1", "clarify", "synonym"), ("Automotive", "program", "TE2", "clarify", "synonym"),
    ("Elite", "program_group", "elite", "group", "name"), ("Khoa Mathematics", "faculty", "MATH", "unique", "name"), ("TOEIC", "certificate", "T1", "group", "synonym"), ("TOEIC", "certificate", "T2", "group", "synonym"),
]
OPEN = [("IT1", 2025), ("IT1", 2026), ("IT2", 2026), ("MT9", 2024), ("TE1", 2026), ("TE2", 2026)]
ASKED = {
    "computer SCIENCE": ("program", None, "unique", "exact", ["IT1"], []),
    "cs": ("program", None, "unique", "exact", ["IT1"], []),
    "computer": ("program", None, "clarify", "substring", ["IT1", "IT2"], []),
    "engineering": ("program", [2025], "not_found", None, [], ["IT2"]),
    "computer sceince": ("program", None, "unique", "fuzzy", ["IT1"], []),
    "old metallurgy": ("program", None, "not_found", None, [], ["MT9"]),
    "old metallurgy ": ("program", [2024], "unique", "exact", ["MT9"], []),
    "automotive": ("program", None, "clarify", "exact", ["TE1", "TE2"], []),
    "elite": ("program", None, "group", "exact", ["IT1"], []),
    "khoa mathematisc": ("faculty", None, "unique", "fuzzy", ["MATH"], []),
    "toeic": ("certificate", None, "group", "exact", ["T1", "T2"], []),
    "khoa": ("program", None, "not_found", None, [], []),
    "": ("program", None, "not_found", None, [], []),
    None: ("program", None, "not_found", None, [], []),
}


def test_cascade(spark):
    mentions = [(i, m, v[0], v[1]) for i, (m, v) in enumerate(ASKED.items())]
    args = (spark.createDataFrame(ENTRIES, "text string, entity_type string, code string, resolution string, kind string"), spark.createDataFrame(OPEN, "code string, year int"),
            spark.createDataFrame([("elite", "IT1"), ("elite", "MT9")], "group_code string, code string"))
    shape = "mention_id int, mention string, entity_type string, years array<int>"
    out = {r["mention_id"]: r for r in resolve(spark.createDataFrame(mentions, shape), *args).collect()}
    got = {m: (t, y, out[i]["status"], out[i]["matched_by"], out[i]["codes"], out[i]["closed"]) for i, m, t, y in mentions}
    assert got == ASKED
    assert resolve(spark.createDataFrame([], shape), *args).count() == 0


def plain(mention, names):
    """status and codes by comparing the mention with every name."""
    exact = sorted({c for k, c in names if k == mention})
    if exact:
        return ("unique" if len(exact) == 1 else "clarify", exact)
    for stage in ("words", "spelling"):
        best = {}
        for k, c in names:
            if stage == "words":
                score = indel_ratio(mention, k) if f" {mention} " in f" {k} " else 0.0
            else:
                score = best_run(mention, k)
            if score >= (85.0 if stage == "spelling" else 1e-9):
                best[c] = max(best.get(c, 0.0), score)
        ranked = sorted(best, key=lambda c: (-best[c], c))
        if len(ranked) == 1 or (ranked and stage == "spelling" and best[ranked[0]] - best[ranked[1]] >= 10):
            return "unique", ranked[:1]
        if ranked:
            return "clarify", [c for c in ranked if stage == "words" or best[ranked[0]] - best[c] < 5][:3]
    return "not_found", []


def test_equals_brute_force(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "system", "systems", "data", "date", "network", "control", "design", "art"]
    names = [(" ".join(rng.sample(words, rng.randint(1, 5))), f"c{i:02d}") for i in range(60)]
    asked = []
    for k, _ in names:
        w = k.split()
        part = " ".join(w[rng.randrange(len(w)) :])
        i = rng.randrange(len(part))
        asked += [k, part, part[:i] + rng.choice("aexz") + part[i + 1 :], part[:i] + part[i + 1 :]]
    asked = sorted({" ".join(a.split()) for a in asked if len(a.strip()) >= 4})
    entries = spark.createDataFrame([(k, "faculty", c, "unique", "name") for k, c in names], "text string, entity_type string, code string, resolution string, kind string")
    mentions = spark.createDataFrame([(i, m, "faculty", None) for i, m in enumerate(asked)], "mention_id int, mention string, entity_type string, years array<int>")
    rows = resolve(mentions, entries, spark.createDataFrame([("x", 2026)], "code string, year int"), spark.createDataFrame([], "group_code string, code string")).collect()
    assert {asked[r["mention_id"]]: (r["status"], r["codes"]) for r in rows} == {m: plain(m, names) for m in asked}
