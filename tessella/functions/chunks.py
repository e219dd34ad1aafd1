"""Chunking folds: greedy packing, clause splitting, carrying short sections, splitting long text."""

from __future__ import annotations

import re
import unicodedata

TARGET, LEAST, SHORT, LONG, NEAR = 1200, 200, 200, 2500, 1800


def pack(paragraphs: list[str], target: int = TARGET, least: int = LEAST) -> list[str]:
    """Paragraphs joined until a chunk reaches target; a tail under least joins the chunk before it."""
    chunks, held = [], ""
    for p in paragraphs:
        held = f"{held}\n{p}" if held else p
        if len(held) >= target:
            chunks.append(held)
            held = ""
    if held and chunks and len(held) < least:
        chunks[-1] += "\n" + held
    elif held:
        chunks.append(held)
    return chunks


def carry_short(sections: list[str], short: int = SHORT) -> list[str]:
    """A section under `short` is put before the next; a last one stays."""
    out, held = [], ""
    for s in sections:
        held = f"{held}\n{s}" if held else s
        if len(held) >= short:
            out.append(held)
            held = ""
    return [*out, held] if held else out


def split_clauses(heading: str, text: str) -> list[str]:
    """Pieces at lines that start with 1., 2., 3. in order, at least two, each after [heading]; what precedes joins the first."""
    parts, held, wanted = [], [], 1
    for line in text.split("\n"):
        if re.match(rf"{wanted}[.)] ", line):
            if wanted > 1:
                parts.append("\n".join(held))
                held = []
            wanted += 1
        held.append(line)
    parts.append("\n".join(held))
    return [f"[{heading}] {p}" for p in parts] if wanted > 2 else [f"[{heading}] {text}"]


def _is_row(line: str) -> bool:
    return line.lstrip().startswith("|")


def split_long(text: str, prefix: str = "", longest: int = LONG, near: int = NEAR) -> list[str]:
    """Text over `longest` in pieces of about `near` characters: between lines, before a list's item where one is in reach, else
    within a line after a space, else anywhere.

    Every character stands in one piece. Pieces after the first begin with the prefix and a line end; one that starts within a
    table begins with the table's header (two lines, if the second is a rule) as well.
    """
    out, start = [], 0
    while len(text) - start > longest:
        ends = [m.end() for m in re.finditer("\n", text[start : start + near])]
        items = [e for e in ends if e > near // 2 and re.match(r"[-*•] |[0-9a-z]{1,2}[.)] ", text[start + e :])]
        space = text.rfind(" ", start, start + near) + 1 - start
        cut = items[-1] if items else ends[-1] if ends else space if space > 0 else near
        out.append((start, start + cut))
        start += cut
    return [_opened(text, prefix, a) * (a > 0) + text[a:z] for a, z in [*out, (start, len(text))]]


def _opened(text: str, prefix: str, at: int) -> str:
    """What a piece that starts at `at` begins with."""
    above, head = text[:at].split("\n")[:-1], []
    if text[at - 1 : at] == "\n" and above and _is_row(above[-1]) and _is_row(text[at:].split("\n", 1)[0]):
        first = next((i for i in range(len(above) - 1, -1, -1) if not _is_row(above[i])), -1) + 1
        ruled = len(above) > first + 1 and re.fullmatch(r"[|\s:-]+", above[first + 1])
        head = above[first : first + (2 if ruled else 1)]
    return "".join(f"{x}\n" for x in [*([prefix] if prefix else []), *head])


def spans(text: str, phrases: list[str]) -> list[tuple[int, int, str]]:
    """Whole-word places of the phrases, longest phrases first, none overlapping another, in order of place."""
    taken, out = [False] * (len(text) + 1), []
    for p in sorted(set(phrases), key=lambda p: (-len(p), p)):
        for m in re.finditer(rf"(?<!\w){re.escape(p)}(?!\w)", text):
            if not any(taken[m.start() : m.end()]):
                taken[m.start() : m.end()] = [True] * (m.end() - m.start())
                out.append((m.start(), m.end(), p))
    return sorted(out)


def folded(text: str) -> tuple[str, list[int]]:
    """The text in lower case without accents, anything but letters and digits a space, and for each of its characters the place in `text`."""
    out, at = [], []
    for i, c in enumerate(text):
        for x in unicodedata.normalize("NFD", "d" if c in "đĐ" else c.lower()):
            if not unicodedata.combining(x):
                out.append(x if x.isalnum() else " ")
                at.append(i)
    return "".join(out), at


def folded_spans(text: str, phrases: list[str]) -> list[tuple[int, int, str]]:
    """spans() of phrases in the folded text, as places in the text itself."""
    plain, at = folded(text)
    return [(at[a], at[z - 1] + 1, p) for a, z, p in spans(plain, phrases)]
