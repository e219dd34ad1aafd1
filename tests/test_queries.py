"""Every registered query against its DuckDB counterpart on the smallest tables."""

import decimal
import glob
import math
import os
import re
import unicodedata
from html import unescape
from urllib.parse import urljoin

import duckdb
import pyarrow.parquet as pq
import pytest

from tessella import catalog

from tessella.functions import chunks
from tessella.functions.text import indel_ratio

SF = "/root/testdata/sf0.001"


def rows(table):
    return pq.read_table(f"{SF}/{table}.parquet").to_pylist()


def of_pages(f):
    return lambda: [(p["page_id"], f(p)) for p in rows("pages")]


def of_documents(f):
    return lambda: [(d["doc_id"], tuple(f(d["text"] or ""))) for d in rows("documents")]


def fuzzy_pairs():
    """All mentions with all names."""
    names = [(n["n_nationkey"], " ".join("".join(c if c.isalnum() else " " for c in n["n_name"].lower()).split())) for n in rows("nation")]
    for asked, name in names:
        mention = name[:-2] + name[:-3:-1]
        found = [(-indel_ratio(mention, key), k, key) for k, key in names if 200 * min(len(mention), len(key)) >= 85 * (len(mention) + len(key))]
        for score, k, key in sorted(f for f in found if f[0] <= -85)[:3]:
            yield {"asked": asked, "mention": mention, "key": key, "n_nationkey": k, "score": -score}


def fuzzy_window_pairs():
    """All mentions with all keys and their runs of about as many words."""
    fold = lambda x: " ".join("".join(c if c.isalnum() else " " for c in x.lower()).split())
    keys = sorted({fold(f"{p['p_type']} {p['p_name']} {p['p_brand']}") for p in rows("part")})
    for asked in sorted({p["p_name"] for p in rows("part")}):
        mention, found = asked[:2] + asked[3:], []
        n = len(mention.split())
        for key in keys:
            w = key.split()
            texts = [key] + [" ".join(w[i : i + m]) for m in (n - 1, n, n + 1) if 1 < n < len(w) for i in range(len(w) - m + 1)]
            found.append((-max(indel_ratio(mention, x) for x in texts if x), key))
        for score, key in sorted(f for f in found if f[0] <= -85)[:5]:
            yield {"asked": asked, "mention": mention, "key": key, "score": -score}


def spans_of(text, phrases):
    """Longest phrases first; a place that is taken is left out."""
    taken, out = set(), []
    for p in phrases:
        for i in range(len(text) - len(p) + 1):
            inside = set(range(i, i + len(p)))
            word = lambda c: c.isalnum() or c == "_"
            if text[i : i + len(p)] == p and not (i and word(text[i - 1])) and not (i + len(p) < len(text) and word(text[i + len(p)])) and not inside & taken:
                taken |= inside
                out.append((i, i + len(p), p))
    return sorted(out)


def spans(text):
    return [f"{a}:{z}:{p}" for a, z, p in spans_of(text, ("of the", "de la", "the", "in", "la"))]


def folded_spans(text):
    """The same in base letters, each letter with its place in the text."""
    letters = [(x, i) for i, c in enumerate(text) for x in unicodedata.normalize("NFD", c.lower().replace("đ", "d")) if not unicodedata.combining(x)]
    plain = "".join(x if x.isalnum() else " " for x, _ in letters)
    return [f"{letters[a][1]}:{letters[z - 1][1] + 1}:{p}" for a, z, p in spans_of(plain, ("of the", "de la", "fur", "the", "la"))]


def mentions_are_resolved(got):
    """Whole names and regions by the catalogue; misspelt names have a cascade of their own tests."""
    nations = {n["n_name"]: n for n in rows("nation")}
    region = {r["r_name"]: r["r_regionkey"] for r in rows("region")}
    home = {c["c_custkey"]: c["c_nationkey"] for c in rows("customer")}
    years = {}
    for o in rows("orders"):
        years.setdefault(str(home[o["o_custkey"]]), set()).add(o["o_orderdate"].year)
    last = max(y for ys in years.values() for y in ys)
    is_open = lambda code: last in years.get(code, ())
    assert len(got) == len(home)
    for r in got:
        if r["mention"] in nations:
            code = str(nations[r["mention"]]["n_nationkey"])
            assert (r["status"], r["codes"], r["closed"]) == (("unique", [code], []) if is_open(code) else ("not_found", [], [code]))
        elif r["mention"] in region:
            members = sorted(str(n["n_nationkey"]) for n in nations.values() if n["n_regionkey"] == region[r["mention"]])
            assert (r["status"], r["group_code"], r["codes"]) == ("group", f"r{region[r['mention']]}", [c for c in members if is_open(c)])


def page_lines(page, part="body", spam=False):
    """The given pages are regular enough for patterns: their navigation, footer and comments are cut out, every tag ends a line."""
    inside = re.search(rf"(?s)<{part}>(.*?)(?:</{part}>|\Z)", page)[1]
    inside = re.sub(r"(?s)<nav>.*?</nav>|<footer>.*?</footer>|<!--.*?-->", "", inside)
    lines = [" ".join(x.split()) for x in unescape(re.sub(r"<[^>]*>", "\n", inside)).split("\n")]
    lines = [x for x in lines if len(x) >= 2 and not (spam and re.search(r"\*\*\*|###", x))]
    lines = [x for i, x in enumerate(lines) if not i or lines[i - 1] != x]
    start = [i for i, x in enumerate(lines) if len(x) >= 100]
    return "\n".join(lines[start[0] :] if start else lines)


def main_lines(page):
    """The article, if it has 500 characters."""
    article = re.search(r"(?s)<article>(.*?)(?:</article>|\Z)", page)[1]
    size = sum(len(unescape(x).strip()) for x in re.split(r"<[^>]*>", re.sub(r"(?s)<footer>.*?</footer>|<!--.*?-->", "", article)))
    return page_lines(page, "article" if size >= 500 else "body", spam=True)


def page_links(p):
    found = {}
    for href, text in re.findall(r'<a href="([^"]*)">(.*?)</a>', p["html"]):
        url = urljoin(p["url"] or "", unescape(href))
        if len(unescape(text).strip()) >= 6 and re.match("https?://", url) and url != p["url"]:
            found.setdefault(url, unescape(text).strip())
    return tuple(f"{u} {x}" for u, x in found.items())


def scanned():
    """Every entry at every place of every document."""
    names = {(x, "name", "part") for x in (r["p_name"] for r in rows("part"))} | {(r["p_brand"], "code", "brand") for r in rows("part")} | {(r["p_type"], "abbrev", "type") for r in rows("part")}
    names |= {(r["n_name"], "code", "nation") for r in rows("nation")} | {(r["s_name"], "code", "supplier") for r in rows("supplier")}
    for d in rows("documents"):
        text = d["text"] or ""
        low, found = text.lower(), []
        for name, kind, what in names:
            if kind == "name":
                if name.split()[0] in low:
                    found += [(m.start(), m.end(), what) for m in re.finditer(r"(?i)(?<![a-z0-9])" + r"[^a-z0-9]+".join(name.split()) + r"(?![a-z0-9])", text)]
            elif name.lower() in low:
                found += [(m.start(), m.end(), what) for m in re.finditer(rf"(?<![\w-]){re.escape(name)}(?![\w-])", text, re.I if kind == "code" else 0)]
        taken = []
        for a, z, what in sorted(found, key=lambda f: (f[0] - f[1], f[0])):
            if all(z <= b or a >= y for b, y, _ in taken):
                taken.append((a, z, what))
        yield d["doc_id"], tuple(f"{a}:{z}:{w}:{text[a:z]}" for a, z, w in sorted(taken)), tuple(sorted({int(y) for y in re.findall(r"(?<!\d)(20\d\d)(?!\d)", text)}))


#: What the queries without SQL give, by functions that have tests of their own, or by brute force.
EXPECTED = {
    "fuzzy_join": lambda: [tuple(r[c] for c in sorted(r)) for r in fuzzy_pairs()],
    "fuzzy_windows": lambda: [tuple(r[c] for c in sorted(r)) for r in fuzzy_window_pairs()],
    "html_text": of_pages(lambda p: page_lines(p["html"])),
    "html_main": of_pages(lambda p: main_lines(p["html"])),
    "html_links": of_pages(page_links),
    "html_facts": of_pages(lambda p: ()),  # the pages have no colon after a label
    "html_tables": of_pages(lambda p: ()),  # nor tables; html_table_rows and html_sections write pages with both
    "scan_sentences": scanned,
    "split_clauses": of_documents(lambda x: chunks.split_clauses("doc", x)),
    "split_long": of_documents(lambda x: chunks.split_long(x, "[doc]")),
    "span_scan": of_documents(spans),
    "span_scan_folded": of_documents(folded_spans),
}
SQL = catalog.oracle_sql()


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else x
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name == "context_update":  # tests/test_dialogue.py has its loop
        return
    if name == "resolve_mentions":
        return mentions_are_resolved(df.collect())
    if name not in SQL:
        assert got == sorted(EXPECTED[name](), key=repr)
        return
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    rel = con.sql(SQL[name])
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
