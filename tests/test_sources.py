"""File sources and sinks."""

import pytest

from tessella.sources import files, sinks


def test_csv_drops_the_mark_and_keeps_text(spark, tmp_path):
    (tmp_path / "p_2025.csv").write_text("﻿code,name\n007,\"a, \"\"b\"\"\"\n", encoding="utf-8")
    (tmp_path / "p_2026.csv").write_text("code,name\n008,\n", encoding="utf-8")
    (tmp_path / "p_extra.csv").write_text("x\n1\n", encoding="utf-8")
    got = files.read_years(spark, str(tmp_path), "p", ["code", "name"]).collect()
    assert sorted(map(tuple, got)) == [("007", 'a, "b"', 2025), ("008", None, 2026)]


def test_csv_refuses_other_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,code\na,1\n")
    with pytest.raises(Exception, match="CSV header|MALFORMED"):
        files.read_csv(spark, str(tmp_path / "a.csv"), ["code", "name"]).collect()


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"chunk_id": "x", "year": 2026, "other": 1}\n{"chunk_id": "y"}\n')
    assert sorted(map(tuple, files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "chunk_id string, year int").collect())) == [("x", 2026), ("y", None)]
    (tmp_path / "b.jsonl").write_text("{oops\n")
    with pytest.raises(Exception, match="CSV header|MALFORMED"):
        files.read_jsonl(spark, str(tmp_path / "b.jsonl"), "chunk_id string").collect()


def test_markdown_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a|b", "1"), (None, "two\nlines")], "k string, v string")
    lines = [r[0] for r in sinks.markdown_lines(rows, ["k", "v"]).collect()]
    (tmp_path / "t.md").write_text("# head\n\n| K | V |\n|---|:-:|\n" + "\n".join(lines) + "\n| one |\n")
    assert sorted(map(tuple, files.read_markdown_table(spark, str(tmp_path / "t.md"), ["k", "v"]).collect())) == [("", "two lines"), ("a|b", "1")]


def test_publish_is_whole_or_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}"
    a, b = spark.range(3), spark.range(5)
    first = sinks.publish({"t": a}, folder)
    assert sinks.current(spark, folder) == first
    with pytest.raises(sinks.Rejected) as e:
        sinks.publish({"t": b}, folder, {"too many": b.where("id > 2")})
    assert e.value.found == {"too many": 2} and sinks.current(spark, folder) == first
    sinks.publish({"t": b}, folder, {"none": b.where("id > 9")})
    assert spark.read.parquet(f"{sinks.current(spark, folder)}/t.parquet").count() == 5


def test_incremental_load(spark):
    shape = "id string, text string, latest boolean"
    old = spark.createDataFrame([("a", "x", True), ("b", None, True)], shape)
    new = spark.createDataFrame([("a", "x", False), ("b", None, True), ("c", "z", True)], shape)
    assert {tuple(r) for r in sinks.changes(old, new, "id", ["text"], ["latest"]).collect()} == {("a", "flag_flip"), ("b", "same"), ("c", "new")}
    assert sinks.add_missing(old, new, "id", ["text"], ["latest"]).count() == 3
    with pytest.raises(sinks.Rejected) as e:
        sinks.add_missing(old, new.where("id <> 'a'").replace("z", "y"), "id", ["text"])
    assert e.value.found == {"gone": 1}


def test_html_tables_nest_and_pages_may_be_broken():
    from tessella.functions import html

    assert html.tables("<table><tr><td>a<table></table>b</td></tr></table>") == [[["ab"]]]
    assert html.tables("<table><tr><td>a<table><tr><td>in<td>two</table>b<td>c") == [[["ab", "c"]], [["in", "two"]]]
    assert html.tables("<table><tr><td>x</td></tr></table><td>loose</td>") == [[["x"]]]
    assert html.tables("</td></table><tr><td>q</td><table><td>no row</table>") == [[["no row"]]]
    assert html.tables(None) == [] and html.main_text("<p>one<p>one<nav>menu</nav><p>two") == "one\ntwo"
    assert html.links('<a href="//[x">bad</a><a href="/b">b</a><a href="u">self</a>', "http://h/u") == [("http://h/b", "b")]
    assert html.facts("<p>Phone: 12<p>Phone: 13<p>no colon") == {"Phone": "12"}


def test_html_rows_by_header():
    from tessella.functions import html

    page = "<table><tr><th>Skip</th></tr></table><table><tr><td>title<tr><th>Code<th>Full name<th>Day<tr><td>Group A<tr><td>1<td>one<td>✓<tr><td>Group B<td><td><tr><td>2<td>two<td></table>"
    assert html.table_rows(page, ("code", "name")) == [{"group": "Group A", "Code": "1", "Full name": "one", "Day": "x"}, {"group": "Group B", "Code": "2", "Full name": "two", "Day": ""}]
    assert html.table_rows(page, ("nowhere",)) == []


def test_csv_and_json_lines_read_back(spark, tmp_path):
    from tessella.sources import sinks

    rows = [(1, 'a "b", c', None), (2, "", "x\ny")]
    df = spark.createDataFrame(rows, "k int, a string, b string")
    sinks.write_csv(df.select("k", "a"), f"{tmp_path}/c")
    back = spark.read.schema("k int, a string").option("header", True).option("escape", '"').csv(f"{tmp_path}/c").collect()
    assert sorted((r["k"], r["a"] or "") for r in back) == [(1, 'a "b", c'), (2, "")]
    sinks.write_jsonl(df, f"{tmp_path}/j")
    assert sorted(tuple(r) for r in spark.read.schema("k int, a string, b string").json(f"{tmp_path}/j").collect()) == rows


def test_upsert_is_idempotent(spark):
    from tessella.sources import sinks

    shape = "k int, v string, point_id string"
    new = spark.createDataFrame([(1, "b"), (1, "a"), (3, "c"), (None, "d")], "k int, v string")
    once = sinks.upserted(spark.createDataFrame([(1, "old", "x"), (2, "kept", "y")], shape), new, "k")
    again = sinks.upserted(once, new, "k")
    got = sorted((r["k"], r["v"]) for r in once.collect())
    assert got == [(1, "a"), (2, "kept"), (3, "c")] and sorted(map(tuple, again.collect())) == sorted(map(tuple, once.collect()))
