"""Text functions as Column expressions, and the few that Spark has no expression for as Arrow UDFs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters with marks and their base letters, fixed: what NFD and the removal of marks give for Latin-1 and Vietnamese.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďđēęěĩłńňōőřśšťũūůűźžơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccddeeeilnnoorsstuuuuzzouaaaaaaaaaaaaeeeeeeeeiioooooooooooouuuuuuuyyyy"


def norm_key(text: Column) -> Column:
    """Lower case, base letters, everything else but a-z and 0-9 one space, trimmed."""
    t = F.translate(F.lower(text), MARKED, PLAIN)
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\p{Mn}+", ""), "[^a-z0-9]+", " "))


def norm_compact(text: Column) -> Column:
    return F.replace(norm_key(text), F.lit(" "), F.lit(""))


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by one bit row per character."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    row = (1 << len(a)) - 1
    for c in b:
        m = where.get(c, 0)
        row = (row + (row & m)) | (row & ~m)
    return len(a) - bin(row & ((1 << len(a)) - 1)).count("1")


def indel_ratio(a: str, b: str) -> float:
    """100 * 2 * LCS / (both lengths): 100 for equal texts, also two empty ones."""
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


#: Ligatures and what they spell.
LIGATURES = (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"))


def without_ligatures(text: Column) -> Column:
    for mark, letters in LIGATURES:
        text = F.replace(text, F.lit(mark), F.lit(letters))
    return text


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode's composed form, for which Spark has no function."""
    return text.str.normalize("NFC")


def spaced_out(text: Column) -> Column:
    """Words whose letters are set apart (four single letters and more, a space between each) closed up."""
    return F.regexp_replace(text, r"(?:(?<!\p{L})(?=(?:\p{L} ){3,}\p{L}(?!\p{L}))|\G(?<!^))(\p{L}) (?=\p{L}(?!\p{L}))", "$1")


def slug(text: Column) -> Column:
    """Lower case, base letters, runs of all else but a-z, 0-9 and points one -; none at the ends."""
    t = F.regexp_replace(F.translate(F.lower(text), MARKED, PLAIN), r"\p{Mn}+", "")
    return F.trim(F.regexp_replace(t, "[^a-z0-9.]+", "-"), F.lit("-"))


def unit_factor(unit: Column, units: tuple[tuple[str, int], ...]) -> tuple[Column, Column]:
    """The factor of the first of `units` that the text starts with, and what follows it. Null stays null, an unknown unit is an error."""
    factor, rest = F.raise_error(F.concat(F.lit("unknown unit: "), unit)).cast("int"), F.lit(None).cast("string")
    for name, k in reversed(units):
        factor = F.when(unit.startswith(name), F.lit(k)).otherwise(factor)
        rest = F.when(unit.startswith(name), F.substr(unit, F.lit(len(name) + 1))).otherwise(rest)
    return F.when(unit.isNotNull(), factor), rest


def cohort_number(text: Column) -> Column:
    """The first number of a text; a calendar year from 1956 on counts from 1955."""
    n = F.nullif(F.regexp_extract(text, "([0-9]+)", 1), F.lit("")).cast("int")
    return F.when(n >= 1956, n - 1955).otherwise(n)


def value_range(text: Column) -> tuple[Column, Column]:
    """Lower and upper end of a range written in text: a - b with any dash or a division mark, a single number (both ends), >, >= or ≥ (no
    upper end); a comma is decimal. Text that doesn't start with one of these has no ends."""
    number = lambda group: F.replace(F.nullif(F.regexp_extract(text, r"^([≥>= ]*)([0-9]+(?:[.,][0-9]+)?)(?: *[-–—÷] *([0-9]+(?:[.,][0-9]+)?))?$", group), F.lit("")), F.lit(","), F.lit(".")).cast("double")
    return number(2), F.when(~text.rlike("^[≥>]"), F.coalesce(number(3), number(2)))
