"""The sentence scan: rules of each class of alias, both ways of the search, random texts against a search of every place."""

import re
import unicodedata

import numpy as np
import pytest

from tessella.operators import scan

ALIASES = [("IT-E10", "code", "program"), ("SEM", "code", "program"), ("BA", "abbrev", "method"), ("Kỹ thuật Ô tô", "name", "program"), ("Kỹ thuật", "name", "faculty"), ("Ô tô", "name", "club"), ("ky thuat", "name", "group"), ("A.1", "code", "room"), ("#7#", "code", "box"), ("abc", "name", "short"), ("Nhà B1", "code", "house"), ("", "name", "x"), (None, "code", "x"), ("--", "code", "x"), ("cà phê", None, None)]
SCHEMA = "alias string, kind string, entity_type string"


def found(spark, texts, aliases=ALIASES, **how):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n long, body string")
    got = scan.scan_sentences(df, spark.createDataFrame(aliases, SCHEMA), "n", "body", **how).collect()
    return [[(m["text"], m["types"]) for m in r["mentions"]] for r in sorted(got, key=lambda r: r["n"])], [r["years"] for r in sorted(got, key=lambda r: r["n"])]


@pytest.mark.parametrize("shipped", [scan.SHIPPED, 3])
def test_classes_and_their_rules(spark, shipped):
    texts = ["ite10, it-e10 and xIT-E10 or IT-E10x", "sem SEM Sem", "ba nam BA", "KY  THUẬT - ô TÔ!", "ky thuat cơ khí, ô tô", "a.1 A.1b -A.1", "see #7# and 7", "abc", "nhà b1", "Ca phe 2024 12025 2031-2024", None, ""]
    got, years = found(spark, texts, shipped=shipped)
    want = [["ite10", "it-e10"], ["SEM"], ["BA"], ["KY  THUẬT - ô TÔ"], ["ky thuat", "ô tô"], ["a.1"], ["#7#"], [], ["nhà b1"], ["Ca phe"], [], []]
    assert [[t for t, _ in x] for x in got] == want
    assert got[4][0][1] == ["faculty", "group"] and got[3][0][1] == ["program"] and got[9][0][1] == [] and years[9] == [2024, 2031]
    assert years[-2:] == [[], []]


def test_codes_that_overlap_are_found_from_the_left(spark):
    for shipped in (scan.SHIPPED, 0):
        assert found(spark, ["A.B.C.D", "x A.B"], [("A.B", "code", "p"), ("B.C.D", "code", "p")], shipped=shipped)[0] == [[("A.B", ["p"])], [("A.B", ["p"])]]


def test_both_ways_equal_a_search_of_every_place(spark):
    rng = np.random.default_rng(4)
    words = ["mây", "MAY", "gió", "g-1", "G1", "AB", "ab", "x_1", "Đá", "da", "núi", "2020", "é", "#", ".", "b.2"]
    draw = lambda n: "".join(words[int(w)] + (" ", " ", "  ", ", ", "-", "")[int(s)] for w, s in zip(rng.integers(0, len(words), n), rng.integers(0, 6, n), strict=True))
    texts = [draw(int(n)) for n in rng.integers(0, 40, 120)] + ["mây gió " * 3000]
    aliases = list(dict.fromkeys((draw(int(n)).strip() or "x1", ("name", "code", "abbrev")[int(k)], "abc"[int(e)]) for n, k, e in zip(rng.integers(1, 4, 60), rng.integers(0, 3, 60), rng.integers(0, 3, 60), strict=True)))

    def plain(c):
        base = "".join(x for x in unicodedata.normalize("NFD", c.lower().replace("đ", "d")) if unicodedata.category(x) != "Mn")
        return base if re.fullmatch("[a-z0-9]", base) else " "

    def search(text):
        folded, low = "".join(map(plain, text)), "".join(c.lower() for c in text)
        cs, ci, names = {}, {}, {}
        for alias, kind, what in aliases:
            if kind == "name":
                if len(key := " ".join("".join(map(plain, alias)).split())) >= 4:
                    names.setdefault(key, set()).add(what)
            else:
                anycase = kind == "code" and re.search(r"[\d_.-]", alias)
                for form in {alias, alias.replace("-", "")} if kind == "code" else {alias}:
                    if re.search(r"[\w-]", form):
                        (ci if anycase else cs).setdefault(form.lower() if anycase else form, set()).add(what)
        spans = []
        for table, where in ((cs, text), (ci, low)):
            if table:
                pattern = "|".join(re.escape(x) for x in sorted(table, key=len, reverse=True))
                spans += [(m.start(), m.end(), sorted(table[m.group()])) for m in re.finditer(rf"(?<![\w-])(?:{pattern})(?![\w-])", where)]
        for key, types in names.items():
            spans += [(m.start(1), m.end(1), sorted(types)) for m in re.finditer(r"(?=(?<![a-z0-9])(" + " +".join(key.split()) + r")(?![a-z0-9]))", folded)]
        taken = []
        for a, z, t in sorted(spans, key=lambda s: (s[0] - s[1], s[0])):
            if all(z <= b or a >= y for b, y, _ in taken):
                taken.append((a, z, t))
        return [(text[a:z], t) for a, z, t in sorted(taken)]

    want = [search(t) for t in texts]
    assert sum(map(len, want)) > 400
    for shipped in (scan.SHIPPED, 10):
        assert found(spark, texts, aliases, shipped=shipped)[0] == want


def test_empty_tables_repeats_and_clashing_names(spark):
    empty = spark.createDataFrame([], SCHEMA)
    df = spark.createDataFrame([(1, "BA 2025", "x", "y"), (1, "BA 2025", "x", "y"), (None, "BA", "x", "y")], "id long, text string, mentions string, cls string")
    for shipped in (scan.SHIPPED, 0):
        got = scan.scan_sentences(df, spark.createDataFrame(ALIASES, SCHEMA), "id", "text", shipped).collect()
        assert sorted((str(r["id"]), len(r["mentions"]), r["years"]) for r in got) == [("1", 1, [2025])] * 2 + [("None", 1, [])]
        assert scan.scan_sentences(df.limit(0), spark.createDataFrame(ALIASES, SCHEMA), "id", "text", shipped).count() == 0
    assert [r["mentions"] for r in scan.scan_sentences(df, empty, "id", "text").collect()] == [[]] * 3


def test_a_large_table_is_looked_up_without_a_shuffle_of_the_texts(spark, monkeypatch):
    """Slices and lookups of a few entries, and a bitmap that is nearly full, give what the automata give."""
    for name, value in (("LOOKED_UP", 7), ("SLICE", 4), ("BITMAP", (1 << 5, 1 << 5))):
        monkeypatch.setattr(scan, name, value)
    texts = ["ite10, it-e10 and IT-E10", "ba nam BA", "KY  THUẬT - ô TÔ!", "ky thuat cơ khí, ô tô, ky thuat", "see #7# and 7", "nhà b1 2024", None, "ba nam BA"]
    want = found(spark, texts)
    for how in ({"shipped": 3}, {"shipped": 3, "listed": 3}):
        assert found(spark, texts, **how) == want
    df = spark.createDataFrame([(1, "BA 2025")], "id long, text string")
    aliases = spark.createDataFrame(ALIASES, SCHEMA)
    plan = scan.scan_sentences(df, aliases, "id", "text", shipped=3)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_a_join_through_a_bitmap_equals_automata(spark):
    rng = np.random.default_rng(9)
    words = ["mây", "MAY", "g-1", "G1", "AB", "ab", "x_1", "Đá", "da", "#", "b.2", "2020"]
    texts = [" ".join(words[int(w)] for w in rng.integers(0, len(words), n)) for n in rng.integers(0, 30, 60)]
    aliases = [(" ".join(words[int(w)] for w in rng.integers(0, len(words), 2)), ("name", "code", "abbrev")[i % 3], "ab"[i % 2]) for i in range(40)]
    assert found(spark, texts, aliases, shipped=0, listed=0) == found(spark, texts, aliases)
    df = spark.createDataFrame([(1, "BA 2025", "x", "y"), (1, "BA 2025", "x", "y"), (None, "BA", "x", "y")], "id long, text string, mentions string, cls string")
    got = scan.scan_sentences(df, spark.createDataFrame(ALIASES, SCHEMA), "id", "text", 0, 0).collect()
    assert sorted((str(r["id"]), len(r["mentions"]), r["years"]) for r in got) == [("1", 1, [2025])] * 2 + [("None", 1, [])]


def tables(aliases):
    """The forms of aliases, for automata, and what texts are looked up in: tables by class, shapes, types."""
    import pyarrow as pa

    forms = {}
    for alias, kind, what in aliases:
        for form in scan.alias_forms(kind or "", alias or ""):
            forms.setdefault(form, set()).add(what or "")
    types = sorted({tuple(sorted(x)) for x in forms.values()})
    known = {}
    for kind in {k for k, _ in forms}:
        own = [f for f in forms if f[0] == kind]
        known[kind] = scan._Known(pa.array([key for _, key in own], pa.string()), np.array([types.index(tuple(sorted(forms[f]))) for f in own]))
    return [(*f, sorted(x)) for f, x in forms.items()], known, sorted({scan.shape_of(*f) for f in forms}), types


def looked_up(texts, known, shapes, types):
    import pyarrow as pa

    places, years = [[] for _ in texts], [[] for _ in texts]
    found, dated = scan._found(pa.array(texts), known, shapes)
    for i, a, z, t, string in zip(*(x.tolist() for x in found[:4]), found[4].to_pylist(), strict=True):
        assert string == texts[i][a:z]
        places[i].append((a, z, list(types[t])))
    for i, y in zip(*(x.tolist() for x in dated), strict=True):
        years[i].append(y)
    return places, years


@pytest.mark.parametrize("mask", [None, 0, 3])
def test_look_ups_in_arrays_equal_automata(monkeypatch, mask):
    """Also where aliases share a hash, or all have the same one."""
    if mask is not None:
        monkeypatch.setattr(scan._Hashes, "__call__", lambda self, a, z, f=scan._Hashes.__call__: f(self, a, z) & np.uint64(mask))
    rng = np.random.default_rng(12)
    words = ["mây", "MAY", "g-1", "G1", "AB", "ab", "x_1", "Đá", "#", "b.2", "2020", "12024", "İx", "ß", "𝒳y", "ét", "\n", "\0", "中文", "ﬁn", "٢٠٢٠"]
    draw = lambda n: "".join(words[int(w)] + (" ", "  ", ", ", "-", "", "/")[int(s)] for w, s in zip(rng.integers(0, len(words), n), rng.integers(0, 6, n), strict=True))
    texts = ["", *[draw(int(n)) for n in rng.integers(0, 30, 400)], "", "AB", "\n"]
    aliases = [*ALIASES, *[(draw(int(n)).strip() or "x1", ("name", "code", "abbrev")[i % 3], "abc"[i % 2]) for i, n in enumerate(rng.integers(1, 4, 150))]]
    forms, *rest = tables(aliases)
    scanner = scan.Scanner(forms)
    want = [scan.chosen(list(scanner.places(x))) for x in texts]
    assert sum(map(len, want)) > 1000 and any(z - a > 6 for x in want for a, z, _ in x)
    assert looked_up(texts, *rest) == (want, [sorted({int(y) for y in re.findall(r"(?<![0-9])20[0-9][0-9](?![0-9])", x)}) for x in texts])


def test_look_ups_take_less_time_than_automata():
    """A request's sentence was cut into runs of words one by one, which took six times as long as automata do."""
    import time

    import pyarrow as pa

    forms, *rest = tables([(f"Supplier#{i:09d}", "code", "supplier") for i in range(20_000)] + [(f"{a} {b}", "name", "part") for a in ("large", "hot", "old") for b in ("ring", "bolt", "gear")] + [("LARGE", "abbrev", "type")])
    texts = [f"Señd {('LARGE', 'HOT', 'OLD')[i % 3]} - {('RING', 'GEAR')[i % 2]} (BRAND#{i % 25}, LARGE) by Supplier#{i * 7 % 20_000:09d} / nation_3, not Brand#7x or large, in {1992 + i % 9}" for i in range(8_000)]
    scanner = scan.Scanner(forms)
    looked_up(texts[:10], *rest)
    t = time.process_time()
    want = [scan.chosen(list(scanner.places(x))) for x in texts]
    automata, t = time.process_time() - t, time.process_time()
    got = [scan._found(pa.array(texts[i : i + 2_000]), *rest[:2]) for i in range(0, len(texts), 2_000)]
    assert time.process_time() - t < automata
    assert sum(len(x[0][0]) for x in got) == sum(map(len, want)) and looked_up(texts[:500], *rest)[0] == want[:500]


def test_automata_are_for_many_shapes_and_mentions_are_written_alike(spark, monkeypatch):
    texts = ["ite10, it-e10 and IT-E10", "ba nam BA", "KY  THUẬT - ô TÔ!", "ky thuat ca phe, ô tô", "see #7# 2031 and 7", "nhà b1 2024 2024", None]
    want = found(spark, texts)
    df = spark.createDataFrame(list(enumerate(texts)), "n long, body string")
    written = lambda **how: sorted(map(tuple, scan.scan_sentences(df, spark.createDataFrame(ALIASES, SCHEMA), "n", "body", written=True, **how).collect()))
    lists, joined = written(), written(shipped=0, listed=0)
    monkeypatch.setattr(scan, "SHAPES", 0)
    assert found(spark, texts) == want and written() == lists == joined
    assert lists[3] == (3, ["0:8:faculty+group:ky thuat", "9:15::ca phe", "17:21:club:ô tô"], []) and lists[5][2] == [2024]
