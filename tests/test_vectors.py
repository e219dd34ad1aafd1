"""The versioned store of vectors: loads rewrite what changes, a scroll gives every point once, failed loads change nothing."""

import pytest
from pyspark.sql import functions as F

from tessella.operators.rules import Checked, Reference, violations
from tessella.sources.sinks import Rejected
from tessella.sources.vectors import POINT, VectorStore, pages

SCHEMA = "chunk string, text string, latest boolean, v array<double>"


def rows(n, move=0.0):
    return [(f"c{i}", f"text {i}", i % 2 == 0, [float(i) + move, 1.0]) for i in range(n)]


def state(store):
    return {r["chunk"]: (r["text"], r["latest"], tuple(r["v"])) for r in store.points().collect()}


@pytest.fixture
def store(spark, tmp_path):
    s = VectorStore(spark, f"file://{tmp_path}/store", "chunk")
    s.create(spark.createDataFrame([*rows(100), (None, "x", None, None), ("c5", "zzz", None, [9.0])], SCHEMA), buckets=16)
    return s


def test_upserts_rewrite_only_what_changes(spark, store):
    assert len(state(store)) == 100 and state(store)["c5"][0] == "text 5"
    before = {r["bucket"]: r["path"] for r in store._manifest()}
    assert store.upsert(spark.createDataFrame(rows(10), SCHEMA)) == [] and before == {r["bucket"]: r["path"] for r in store._manifest()}
    touched = store.upsert(spark.createDataFrame([("c7", "new text", True, [0.5]), ("c8", *rows(9)[8][1:]), ("extra", "e", None, None)], SCHEMA))
    after = {r["bucket"]: r["path"] for r in store._manifest()}
    assert 1 <= len(touched) <= 2 and {b for b in after if after[b] != before.get(b)} == set(touched)
    got = {r["chunk"]: r["text"] for r in store.points().collect()}
    assert len(got) == 101 and got["c7"] == "new text" and got["extra"] == "e" and got["c6"] == "text 6"


def test_missing_points_are_added_and_vectors_stay(spark, store):
    new = [(c, t, not f if c == "c3" else f, v) for c, t, f, v in rows(103, move=0.25)]
    touched = store.add_missing(spark.createDataFrame(new, SCHEMA), ["text"], ["latest"])
    got = state(store)
    assert len(got) == 103 and got["c3"] == ("text 3", True, (3.0, 1.0)) and got["c4"][2] == (4.0, 1.0) and got["c102"][2] == (102.25, 1.0) and 1 <= len(touched) <= 4
    assert store.add_missing(spark.createDataFrame(new, SCHEMA), ["text"], ["latest"]) == []
    for bad in (new[1:], [("c0", "other", True, [0.0]), *new[1:]]):
        with pytest.raises(Rejected):
            store.add_missing(spark.createDataFrame(bad, SCHEMA), ["text"], ["latest"])
    assert state(store) == got


def test_a_scroll_gives_every_point_once(spark, store):
    for limit in (7, 50, 100, 256):
        seen, after = [], None
        while True:
            page, after = store.scroll(after, limit)
            seen += [[r[POINT] for r in page.collect()]]
            if after is None:
                break
        flat = [x for p in seen for x in p]
        assert flat == sorted(r[POINT] for r in store.points().collect()) and all(len(p) == limit for p in seen[:-1])
    numbered = pages(store.points().select("chunk"), "chunk", 7, 16).collect()
    assert sorted(r["page"] for r in numbered) == sorted(i // 7 for i in range(100))
    assert store.scroll("f" * 64)[1] is None


def test_a_load_that_fails_changes_nothing(spark, store):
    got = state(store)
    bad = spark.createDataFrame([("c1", "x", True, [1.0])], SCHEMA).withColumn("text", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        store.upsert(bad)
    assert state(store) == got


def test_rules_of_nulls_and_empty_tables(spark):
    a = spark.createDataFrame([(1, None, "x"), (1, 2, None), (2, 9, "y"), (None, 1, "z"), (None, None, "z")], "id int, parent int, name string")
    checked = [Checked(a, "id", [("no name", "warning", "name IS NULL"), ("odd", "error", "parent % 2 = 1")], "key", [Reference("lost", "error", "parent", "'a'"), Reference("loop", "error", "parent", "'a'", "id = 1", True)], [("a", "id", "true")])]
    got = sorted(tuple(map(str, r)) for r in violations(checked).collect())
    assert got == sorted([("no name", "warning", "1"), ("odd", "error", "2"), ("odd", "error", "None"), ("key", "error", "1"), ("key", "error", "None"), ("lost", "error", "2"), ("loop", "error", "1")])
    assert violations([Checked(a.limit(0), "id", checked[0].rows, "key", checked[0].references, checked[0].provides)]).count() == 0
