"""The tree of malformed pages, and what is read from it."""

from tessella.functions import html

LONG = "word " * 30


def test_the_container_is_the_smallest_of_the_surest_pattern():
    side, article = f"<div class='sidebar content'>{LONG * 5}</div>", f"<div class='entry-content big'><p>short</p><p>{LONG}</p><p>{LONG}</p><div class='entry-content'>{LONG * 4} inner</div></div>"
    assert html.main_text(f"<body><p>top</p>{side}{article}</body>").endswith("inner") and "short" not in html.main_text(f"<body>{side}{article}</body>")
    assert html.main_text(f"<body>{side}<div class='DESCRIPTION'>{LONG * 5}<b>!!</b></div></body>").endswith("!!")
    assert html.main_text(f"<body>{side}<div class='descriptions'>{LONG * 5}!!</div></body>") == LONG.strip() + " " + " ".join([LONG.strip()] * 4)
    small = "<body><p>a few</p><div class=content>too small</div><p>a few</p><p>a few</p></body>"
    assert html.main_text(small) == "a few\ntoo small\na few"
    assert html.main_text(f"<p>menu</p><p>{LONG}</p><p>end</p>") == LONG.strip() + "\nend"
    assert html.main_text(f"<p>{LONG}</p><p>cheap bets</p>x<p>yes &amp; no</p>", spam="BETS") == LONG.strip() + "\nyes & no"


def test_what_is_never_closed_swallows_nothing():
    assert html.main_text("<body><nav><ul><li>menu</ul><p>kept</p></body>") == "menu\nkept"
    assert html.main_text("<body><nav><ul><li>menu</ul></nav><p>kept</p><header>gone</header><form>also") == "kept\nalso"
    assert html.main_text("<p>a1<script>var x='</p>'</script><style>p{}</style></p><p>b2</p></div></table><b>c3") == "a1\nb2\nc3"
    assert html.main_text("") == "" and html.main_text(None) == "" and html.main_text("plain text") == "plain text"
    assert html.main_text("<div>" * 50_000 + "deep" + "</div>" * 50_000) == "deep"
    assert html.links("<a href='/one'>first link<a href='two'>second link<p>more", "http://h/x/") == [("http://h/one", "first link"), ("http://h/x/two", "second link more")]


def test_links_are_whole_kept_once_and_not_the_page_itself():
    page = "<nav><a href=/a>a long text</a></nav><a href='/a'>again a text</a><a>no address</a><a href='http://[x'>a bad address</a><a href=' /b.pdf '>the <b>file</b></a><a href='/c'>short</a><a href='/p'>this page</a>"
    assert html.links(page, "http://h/p", least=6) == [("http://h/a", "a long text"), ("http://h/b.pdf", "the file")]
    assert html.links(page, "http://h/p", keep=r"\.pdf$") == [("http://h/b.pdf", "the file")] and html.links(page, None)[-1][0] == "/p"


def test_facts_by_label():
    page = "<ul><li>Fee: <b>12</b><li>Years : 4<li>no label<li>: empty<li>Note:</ul><p>Place: Hanoi: west</p><table><tr><th>Head<td>value</tr><tr><td>a<td>b<td>c</table><form><p>Fee: 9</p></form><p>FEE: 13</p>"
    assert html.facts(page) == {"Fee": "12", "Years": "4", "Place": "Hanoi: west", "Head": "value", "FEE": "13"}
    assert html.facts(page, {"fee": "fee", "head": "h"}) == {"fee": "13", "h": "value"} and html.facts(None) == {}
    assert html.facts("<li>Te\N{COMBINING CIRCUMFLEX ACCENT} : a<span> \N{COMBINING DOT BELOW}</span>b") == {"Tê": "ạ b"}


def test_sections_by_title():
    page = "<section><h2>One</h2><p>a</p><p>a</p><ul><li>x<li>y <b>z</b><ul><li>deep</ul></ul><h3>sub</h3><p><strong>bold</strong> on</p><strong>alone</strong><section><h4>Inner</h4><p>b</p></section></section><section><p>no title</p></section><section><h2>Skip</h2><p>c</p></section><section><h2>None</h2><p>See More</p></section>"
    assert html.sections(page, frozenset({"skip"}), frozenset({"see more"})) == [("One", "a\n\n- x\n- y z deep\n\nsub\n\nbold on\n\nalone"), ("Inner", "b")]
    classed = "<section><h2 class='big'>Not this</h2><h4 class='sec-title'>T</h4><p>out</p><div class='sec-con'><p>in</p></div></section>"
    assert html.sections(classed, title_class="^sec-title$", body_class="sec-con") == [("T", "in")] and html.sections("") == []


def test_tables_with_spans():
    page = "<table><tr><th rowspan=2>A<th colspan=2>B<tr><td>b1<td>b2<tr><td colspan='3'>all<tr><td rowspan=9>x<td rowspan=0>y<td>✓<tr><td colspan=bad>z<table><tr><td>in</table></table>"
    assert html.tables(page) == [[["A", "B", "B"], ["A", "b1", "b2"], ["all"] * 3, ["x", "y", "x"], ["x", "z"]], [["in"]]]
    assert html.tables("<table></table><td>loose</td>") == [] and html.tables("<table><tr></tr></table>") == []
    assert html.tables("<table><tr><td>1<td rowspan=2>2<tr></table>") == [[["1", "2"], ["", "2"]]]


def test_rows_of_the_table_with_the_header():
    page = """<table><tr><td>other</td><td>x</td></tr></table><table><tr><td colspan=4>Title</tr><tr><th>No<th>Name of course<th>Quota<th>Exam</tr><tr><td colspan=4>A. First group</td></tr>
      <tr><td>1<td>Maths<td>40<td>√</tr><tr><td><td><td><td></tr><tr><td colspan=4>a remark</tr><tr><td>2<td>Art<td><td></tr><tr><td>B. Second</tr><tr><td>3<td>Law<td>9<td>☑</tr></table>"""
    want = [("First group", "1", "Maths", "40", "x"), ("First group", "2", "Art", "", ""), ("Second", "3", "Law", "9", "x")]
    got = html.table_rows(page, ("name", "quota"), r"^[A-Z]\. (.+)$")
    assert [tuple(r[c] for c in ("group", "No", "Name of course", "Quota", "Exam")) for r in got] == want
    assert html.table_rows(page, ("absent",)) == [] and html.table_rows(page, ("name",))[2]["group"] == "B. Second"
