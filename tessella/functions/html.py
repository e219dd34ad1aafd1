"""HTML as a tree, by the standard library's parser: main text, links, labelled facts, sections, tables. Any page is read, however its tags are nested."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

#: Elements that are no main content; elements without an end tag.
DROPPED = {"script", "style", "nav", "header", "footer", "noscript", "form"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements that an element of the name ends where they are open, and those within which it does.
ENDS = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "a": ({"a"}, {"td", "th", "table"}),
}
_BLOCKS = {"div", "section", "article", "table", "td", "th", "ul", "ol", "li", "dl", "blockquote"}
ENDS |= {x: ({"p"}, _BLOCKS) for x in ("p", "div", "section", "article", "table", "ul", "ol", "dl", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6")}
#: Class patterns of articles' containers, the surest first; characters of one at least, and of the line at which an article starts.
CONTAINERS = (r"^description$", r"article-content|entry-content|post-content", r"content|entry|post|detail")
CONTAINER_LEAST, START_LEAST = 500, 100
#: Marks that stand for yes in a table's cell.
TICKS = {"✓", "✔", "☑", "√"}
#: The widest and highest spans of a cell that are read.
SPANS = (1000, 65534)


class Node:
    __slots__ = ("attrs", "children", "closed", "parent", "tag")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.children, self.closed = tag, attrs, parent, [], False

    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def dropped(self) -> bool:
        """An element that was never closed is none: what follows it is read. Scripts and styles end with the page at most."""
        return self.tag in DROPPED and (self.closed or self.tag in ("script", "style"))

    def walk(self, whole: bool = False) -> Iterator[Node | str]:
        """Elements and texts below, in order; without what is dropped, unless whole."""
        stack = [iter(self.children)]
        while stack:
            for x in stack[-1]:
                if isinstance(x, Node) and not whole and x.dropped():
                    continue
                yield x
                if isinstance(x, Node):
                    stack.append(iter(x.children))
                    break
            else:
                stack.pop()

    def elements(self, *tags: str, whole: bool = False) -> Iterator[Node]:
        return (x for x in self.walk(whole) if isinstance(x, Node) and (not tags or x.tag in tags))

    def texts(self, whole: bool = False) -> Iterator[str]:
        return (x for x in self.walk(whole) if isinstance(x, str))

    def text(self, whole: bool = False) -> str:
        """Words of all texts below, between texts a space; accents set apart are put back on their letters."""
        joined = squeezed(" ".join(s for x in self.texts(whole) if (s := x.strip())))
        return unicodedata.normalize("NFC", re.sub(r"\s+(?=[̀-ͯ])", "", joined))

    def within(self, *tags: str) -> Node | None:
        up = self.parent
        while up is not None and up.tag not in tags:
            up = up.parent
        return up


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in ENDS:
            ended, bounds = ENDS[tag]
            up, last = self.at, None
            while up.parent is not None and up.tag not in bounds:
                if up.tag in ended:
                    last = up
                up = up.parent
            if last is not None:
                self.at = last.parent
        if tag in ("td", "th") and (up := Node("", {}, self.at).within("tr", "table")) is not None and up.tag == "table":
            self.handle_starttag("tr", [])  # cells without a row make one
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.children.append(node)
        if tag in VOID:
            node.closed = True
        else:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        up = self.at
        while up.parent is not None and up.tag != tag:
            if up.tag == "table":  # a stray end tag within a table ends nothing outside it
                return
            up = up.parent
        if up.parent is not None:
            up.closed = True
            self.at = up.parent

    def handle_data(self, data):
        self.at.children.append(data)


def squeezed(text: str) -> str:
    return " ".join(text.split())


def tree(html: str | Node | None) -> Node:
    """The root of the page's elements. What is left open ends with the element around it. A tree is itself: what reads one page several ways builds one."""
    if isinstance(html, Node):
        return html
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def container(root: Node, patterns=CONTAINERS, least: int = CONTAINER_LEAST) -> Node:
    """The smallest element with `least` characters of text and a class of the first pattern that has such an element; else the body, else the page."""
    sizes: dict[int, int] = {}
    order = [root, *root.elements()]
    for node in reversed(order):
        sizes[id(node)] = sum(len(x.strip()) if isinstance(x, str) else sizes.get(id(x), 0) for x in node.children)
    for p in patterns:
        found = [n for n in order[1:] if sizes[id(n)] >= least and any(re.search(p, c, re.I) for c in n.classes())]
        if found:
            return min(found, key=lambda n: sizes[id(n)])
    return next(root.elements("body"), root)


def main_text(html: str | Node | None, spam: str | None = None, start: int = START_LEAST) -> str:
    """Lines of the page's container, one a text, of two characters and more, without spam and adjacent repeats, from the first line of `start` characters on, if there is one."""
    lines: list[str] = []
    for raw in "\n".join(container(tree(html)).texts()).splitlines():
        line = squeezed(raw)
        if len(line) >= 2 and not (spam and re.search(spam, line, re.I)) and not (lines and lines[-1] == line):
            lines.append(line)
    first = next((i for i, x in enumerate(lines) if len(x) >= start), 0)
    return "\n".join(lines[first:])


def links(html: str | Node | None, base: str | None, least: int = 0, keep: str = "") -> list[tuple[str, str]]:
    """Absolute url and text of the links with a text of `least` characters and a url that matches `keep`; each url once, without the page itself. What is no url is left out."""
    found: dict[str, str] = {}
    for a in tree(html).elements("a", whole=True):
        text = a.text(whole=True)
        if "href" not in a.attrs or len(text) < least:
            continue
        try:
            url = urljoin(base or "", a.attrs["href"].strip())
        except ValueError:  # such as an unclosed bracket of an address
            continue
        if url != base and re.search(keep, url):
            found.setdefault(url, text)
    return list(found.items())


def facts(html: str | Node | None, labels: dict[str, str] | None = None) -> dict[str, str]:
    """`label: value` items, paragraphs and table rows of two cells outside what is dropped. The first value of a label counts; with `labels` (in lower case), only those, under their keys, and the last value of a key."""
    found: dict[str, str] = {}
    for node in tree(html).elements("li", "p", "dd", "tr"):
        if node.tag == "tr":
            cells = [x for x in node.children if isinstance(x, Node) and x.tag in ("td", "th")]
            pair = [c.text() for c in cells] if len(cells) == 2 else None
        else:
            text = node.text()
            pair = text.split(":", 1) if ":" in text else None
        if pair:
            label, value = pair[0].strip(" :"), pair[1].strip()
            key = labels.get(label.lower()) if labels is not None else label if 2 <= len(label) <= 40 else None
            if key and value and (labels is not None or key not in found):
                found[key] = value
    return found


def sections(html: str | Node | None, skip: frozenset[str] = frozenset(), noise: frozenset[str] = frozenset(), title_class: str = "", body_class: str = "") -> list[tuple[str, str]]:
    """Title and body of each section with a heading (h2 or h4, of a class if one is asked for) whose title isn't to be skipped (lower case).

    The body is that of the first element of `body_class`, or else the section's: paragraphs, lower headings and strong texts
    and lists, item by item, each text once, without noise. A section without a body is left out. Sections within sections are their own.
    """
    has = lambda node, c: not c or any(re.search(c, x) for x in node.classes())
    out = []
    for sec in tree(html).elements("section"):
        head = next((h for h in sec.elements("h2", "h4") if has(h, title_class) and h.within("section") is sec), None)
        title = head.text() if head else ""
        if not title or title.lower() in skip:
            continue
        body = next((x for x in sec.elements() if body_class and has(x, body_class)), sec)
        parts: dict[str, None] = {}
        for node in body.elements("p", "ul", "ol", "h3", "h4", "strong"):
            if node is head or node.within("section") is not sec or node.within("li") or (node.tag == "strong" and node.within("p", "h3", "h4")):
                continue
            items = [li.text() for li in node.elements("li") if li.within("ul", "ol") is node] if node.tag in ("ul", "ol") else []
            text = "\n".join(f"- {x}" for x in items if x) if items else node.text()
            if text and text.lower() not in noise:
                parts.setdefault(text)
        if parts:
            out.append((title, "\n\n".join(parts)))
    return out


def cell_text(cell: Node) -> str:
    """A cell's own text: inline elements join their letters, others end a word; what a nested table holds is that table's."""
    out, stack = [], [iter(cell.children)]
    while stack:
        for x in stack[-1]:
            if isinstance(x, str):
                out.append(x)
            elif x.tag != "table" and not x.dropped():
                out.append(" " if x.tag in _BLOCKS or x.tag in ("p", "br", "h1", "h2", "h3", "h4", "h5", "h6") else "")
                stack.append(iter(x.children))
                break
        else:
            stack.pop()
    return squeezed("".join(out))


def _span(cell: Node, name: str, most: int) -> int:
    n = cell.attrs.get(name, "1").strip()
    return min(max(int(n), 1), most) if n.isdecimal() else 1


def grid(table: Node) -> list[list[tuple[str, Node | None]]]:
    """The table's own rows of (text, cell): a cell that spans rows or columns stands in each place that it covers. A tick is x."""
    out: list[list[tuple[str, Node | None]]] = []
    hanging: dict[int, tuple[int, tuple[str, Node]]] = {}  # column: rows to come, cell
    for tr in (x for x in table.elements("tr") if x.within("table") is table):
        row: list[tuple[str, Node | None]] = []

        def hung():
            while len(row) in hanging:  # noqa: B023
                left, what = hanging.pop(len(row))  # noqa: B023
                if left > 1:
                    after[len(row)] = left - 1, what  # noqa: B023
                row.append(what)  # noqa: B023

        after: dict[int, tuple[int, tuple[str, Node]]] = {}
        for cell in (x for x in tr.elements("td", "th") if x.within("tr") is tr):
            hung()
            own = cell_text(cell)
            what = ("x" if own in TICKS else own, cell)
            down = _span(cell, "rowspan", SPANS[1])
            for _ in range(_span(cell, "colspan", SPANS[0])):
                if down > 1:
                    after[len(row)] = down - 1, what
                row.append(what)
        while hanging:
            if len(row) not in hanging:
                row.append(("", None))
            hung()
        hanging = after
        out.append(row)
    return out


def tables(html: str | Node | None) -> list[list[list[str]]]:
    """Rows of texts of each table with rows, in the order in which the tables open; spans are filled in, a nested table is one of its own."""
    found = [[[x for x, _ in row] for row in grid(t)] for t in tree(html).elements("table")]
    return [t for t in found if any(t)]


def table_rows(html: str | Node | None, keywords: tuple[str, ...], group: str = "") -> list[dict[str, str]]:
    """Rows of the first table with a header that holds every keyword (lower case), as maps of header to text.

    The header is the first row with all keywords; as many rows belong to it as its highest cell spans, and a column's
    name is made of their texts, each once. A row of one filled cell, in a table of several columns, is a heading: it is the value of
    `group` in the rows after it if it matches the pattern `group`, whose first parenthesis counts. Rows without text are left out.
    """
    for table in tree(html).elements("table"):
        rows = grid(table)
        at = next((i for i, r in enumerate(rows) if len(r) > 1 and all(any(k in x.lower() for x, _ in r) for k in keywords)), None)
        if at is None:
            continue
        high = max(_span(c, "rowspan", SPANS[1]) for _, c in rows[at] if c)
        head = rows[at : at + high]
        names = [" ".join(dict.fromkeys(r[k][0] for r in head if k < len(r) and r[k][0])) for k in range(len(rows[at]))]
        out, heading = [], ""
        for row in rows[at + high :]:
            if len({id(c) for x, c in row if x}) <= 1:
                text = next((x for x, _ in row if x), "")
                if text and (m := re.search(group, text)):
                    heading = m[1] if m.groups() else text
            else:
                out.append({"group": heading} | {n: x for n, (x, _) in zip(names, row, strict=False)})
        return out
    return []
