"""Folded words of a text in plain Python, for stages that need their places in it."""

from __future__ import annotations

import re
import unicodedata

RUN = re.compile(r"[^ ]+")


class PerCharacter(dict):
    """A table for str.translate with one character for each, so that places in the result are places in the text."""

    def __init__(self, f):
        self.f = f

    def __missing__(self, code):
        self[code] = out = self.f(chr(code))
        return out


def _folded(c: str) -> str:
    base = "".join(x for x in unicodedata.normalize("NFD", c.lower().replace("đ", "d")) if unicodedata.category(x) != "Mn")
    return base if len(base) == 1 and ("a" <= base <= "z" or "0" <= base <= "9") else " "


_FOLD = PerCharacter(_folded)


def fold(text: str) -> tuple[str, list[tuple[int, int]]]:
    """Lower case, no accents, words of a-z and 0-9 with one space between them; and each word's place in the text."""
    plain = text.translate(_FOLD)
    spans = [m.span() for m in RUN.finditer(plain)]
    return " ".join(plain[a:z] for a, z in spans), spans
