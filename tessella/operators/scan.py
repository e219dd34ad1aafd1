"""Sentence scan: codes, abbreviations and names of an alias table found in whole texts, longest first, none overlapping another."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.folding import RUN, PerCharacter, fold

#: Letters that a name needs, folded, to be looked for.
LEAST = 4
#: Aliases that a task gets as an automaton, at most, and as Arrow strings; with a larger table, word runs of the texts are joined.
SHIPPED, LISTED = 100_000, 2_000_000
#: Shapes up to which runs of words are looked up whatever the table.
SHAPES = 64
#: Letters of texts whose runs of words are looked up at once, and aliases that are hashed at once.
LOOKED_UP, SLICE = 250_000, 200_000
#: Bits an alias, and bits at least and at most, of the bitmap that word runs pass before they are looked up or joined.
SPARSE, BITMAP = 16, (1 << 16, 1 << 28)
YEAR = re.compile(r"(?<!\d)(20\d\d)(?!\d)")
#: The classes of aliases: letter case counts, letter case doesn't count, folded names.
EXACT, LOWER, FOLDED = "exact", "lower", "folded"
_TOKEN = re.compile(r"[\w-]+")


_LOW = PerCharacter(lambda c: c.lower() if len(c.lower()) == 1 else c)


def alias_forms(kind: str, alias: str) -> list[tuple[str, str]]:
    """Class and key under which an alias is looked for. A code with a digit or one of -_. is found in any letter case, with and without its hyphens."""
    if kind in ("code", "abbrev"):
        cased = EXACT if kind == "abbrev" or not re.search(r"[\d\-_.]", alias) else LOWER
        forms = {alias} if kind == "abbrev" else {alias, alias.replace("-", "")}
        return [(cased, x if cased == EXACT else x.translate(_LOW)) for x in sorted(forms) if _TOKEN.search(x)]
    key = fold(alias)[0]
    return [(FOLDED, key)] if len(key) >= LEAST else []


def _free(text: str, a: int, z: int) -> bool:
    """Whether no letter, digit, _ or - touches the place."""
    return not (a and (text[a - 1].isalnum() or text[a - 1] in "_-")) and not (z < len(text) and (text[z].isalnum() or text[z] in "_-"))


def _leftmost(found):
    """Of the places of codes, those that a search from the left finds: the longest at each start, then on after its end."""
    end = 0
    for a, z, what in sorted(found, key=lambda f: (f[0], -f[1])):
        if a >= end:
            end = z
            yield a, z, what


def chosen(found) -> list[tuple[int, int, list[str]]]:
    """Places of all classes, given as (class, start, end, types): longest first, then from the left; one that overlaps a place taken is left out."""
    spans = [(a, z, t) for kind in (EXACT, LOWER) for a, z, t in _leftmost([f[1:] for f in found if f[0] == kind])]
    spans += [f[1:] for f in found if f[0] == FOLDED]
    taken: list[tuple[int, int, list[str]]] = []
    used = bytearray(max((z for _, z, _ in spans), default=0))
    for a, z, types in sorted(spans, key=lambda s: (s[0] - s[1], s[0])):
        if not any(used[a:z]):
            used[a:z] = b"\1" * (z - a)
            taken.append((a, z, types))
    return sorted(taken)


class Scanner:
    """Three automata, built once a task: (class, key, types) of the whole alias table."""

    def __init__(self, forms: list[tuple[str, str, list[str]]]):
        import ahocorasick

        self.automata = {}
        for kind in (EXACT, LOWER, FOLDED):
            own = [(key, types) for k, key, types in forms if k == kind]
            if own:
                a = ahocorasick.Automaton()
                for key, types in own:
                    a.add_word(f" {key} " if kind == FOLDED else key, (len(key), key.count(" "), types))
                a.make_automaton()
                self.automata[kind] = a

    def places(self, text: str):
        for kind, automaton in self.automata.items():
            if kind == FOLDED:
                plain, spans = fold(text)
                for end, (n, more, types) in automaton.iter(f" {plain} "):
                    first = plain.count(" ", 0, end - n - 1)
                    yield kind, spans[first][0], spans[first + more][1], types
            else:
                for end, (n, _, types) in automaton.iter(text if kind == EXACT else text.translate(_LOW)):
                    if _free(text, end + 1 - n, end + 1):
                        yield kind, end + 1 - n, end + 1, types


def windows(text: str, shapes: list[tuple[str, int, int, int]]):
    """Class, start, end, key of every run of words in the text that could be an alias of one of the shapes (class, marks before, words, marks after)."""
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    low, (plain, spans) = text.translate(_LOW), fold(text)
    words = plain.split(" ")
    for kind, before, n, after in shapes:
        runs = spans if kind == FOLDED else tokens
        for i in range(len(runs) - n + 1):
            a, z = runs[i][0] - before, runs[i + n - 1][1] + after
            if kind == FOLDED:
                yield kind, a, z, " ".join(words[i : i + n])
            elif a >= 0 and z <= len(text) and _free(text, a, z):
                yield kind, a, z, (low if kind == LOWER else text)[a:z]


def shape_of(kind: str, key: str) -> tuple[str, int, int, int]:
    spans = [m.span() for m in (RUN if kind == FOLDED else _TOKEN).finditer(key)]
    return kind, spans[0][0], len(spans), len(key) - spans[-1][1]


def alias_keys(aliases: DataFrame) -> DataFrame:
    """cls, key, types of an alias table (alias, kind, entity_type); kind is code, abbrev or anything else for names. Null and empty aliases name nothing."""
    forms = F.udf(lambda kind, alias: alias_forms(kind or "", alias or ""), "array<struct<cls string, key string>>")
    rows = aliases.select("entity_type", F.explode(forms("kind", "alias")).alias("form"))
    return rows.groupBy("form.cls", "form.key").agg(F.sort_array(F.collect_set("entity_type")).alias("types"))


_MENTIONS = "array<struct<text: string, start: int, end: int, types: array<string>>>"


def scan_sentences(texts: DataFrame, aliases: DataFrame, id_col: str, text_col: str, shipped: int = SHIPPED, listed: int = LISTED, written: bool = False) -> DataFrame:
    """id, mentions (text, start, end, types; in order of place), years (20xx) of every whole text.

    Aliases are found in three ways. Codes with a digit or one of -_. in any letter case, with and without their hyphens; other
    codes and abbreviations as they are written; names of four letters and more whatever the letter case, accents and marks.
    None is found within a word. Longer places go first, then those further left, and no two overlap.

    A table of `listed` aliases at most, whose shapes are SHAPES at most, is sent as Arrow strings, in which the texts' runs of
    words, in the shapes that aliases have, are looked up, many texts at a time: texts aren't shuffled. Of one of `shipped` aliases
    at most in more shapes, each task builds automata; others of `listed` at most are looked up too. Of a larger one only a
    bitmap is sent, and the runs that pass it are joined with the table. All give the same result. Null texts are empty ones;
    repeated rows each have a result; an id or type may be null; an empty alias table finds years only. With `written`, each
    mention is a string, `start:end:types:text`.
    """
    keys = alias_keys(aliases).persist()
    try:
        n, shapes = keys.count(), _shapes(keys)
        rows = texts.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        if n <= listed and (n > shipped or len(shapes) <= SHAPES):
            return _by_list(rows, keys, shapes, written).withColumnRenamed("id", id_col)
        found = _by_automaton(rows, keys.collect()) if n <= min(shipped, listed) else _by_join(rows, keys, n, shapes)
    finally:
        keys.unpersist()
    years = F.sort_array(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"(?<![0-9])(20[0-9][0-9])(?![0-9])"), F.lit(1)), lambda y: y.cast("int"))))
    mentions = F.transform("mentions", lambda m: F.concat_ws(":", m["start"], m["end"], F.array_join(m["types"], "+"), m["text"])) if written else F.col("mentions")
    return found.select(F.col("id").alias(id_col), mentions.alias("mentions"), years.alias("years"))


def _by_automaton(rows: DataFrame, keys: list) -> DataFrame:
    forms = rows.sparkSession.sparkContext.broadcast([(r["cls"], r["key"], list(r["types"])) for r in keys])

    def run(batches):
        import pyarrow as pa

        scanner = Scanner(forms.value)
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                out.append([{"text": text[a:z], "start": a, "end": z, "types": t} for a, z, t in chosen(list(scanner.places(text)))])
            kind = pa.list_(pa.struct([("text", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("types", pa.list_(pa.string()))]))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("text"), pa.array(out, kind)], ["id", "text", "mentions"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string, mentions {_MENTIONS}")


def _shapes(keys: DataFrame) -> list[tuple]:
    """Kinds of shapes, not aliases."""
    shape = F.udf(lambda kind, key: shape_of(kind, key), "struct<cls: string, before: int, n: int, after: int>")
    return [tuple(r[0]) for r in keys.select(shape("cls", "key").alias("s")).distinct().collect()]


def _runs(mask) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of a mask whose first and last entries are False."""
    edges = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    return edges[::2], edges[1::2]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class _Letters:
    """Code points in lower case, folded, and whether they are parts of words, looked up for whole arrays; filled in as letters come."""

    #: Code points that are filled in at once: Latin, Greek and Cyrillic.
    COMMON = 0x500

    def __init__(self):
        size = 0x110000
        self.known, self.token, self.low, self.plain = np.zeros(size, bool), np.zeros(size, bool), np.zeros(size, np.uint32), np.zeros(size, np.uint32)
        self.learn(np.arange(self.COMMON))

    def learn(self, codes) -> None:
        if codes.max() < self.COMMON and self.known[0]:
            return
        for code in np.unique(codes[~self.known[codes]]).tolist():
            c = chr(code)
            self.known[code], self.token[code] = True, _TOKEN.match(c) is not None
            self.low[code], self.plain[code] = ord(c.translate(_LOW)), ord(fold(c)[0] or " ")


_LETTERS: list[_Letters] = []


def _letters() -> _Letters:
    """One table a process."""
    if not _LETTERS:
        _LETTERS.append(_Letters())
    return _LETTERS[0]


#: An odd number, whose powers weigh the letters of a run modulo 2 ** 64, and one that spreads the sum over the bitmap.
_BASE, _SPREAD = 0x9E3779B97F4A7C15, np.uint64(0xC2B2AE3D27D4EB4F)


@lru_cache(2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    powers = np.full((2, size), 1, np.uint64)
    powers[0, 1:], powers[1, 1:] = _BASE, pow(_BASE, -1, 1 << 64)
    return tuple(np.cumprod(powers, axis=1))


class _Hashes:
    """Hashes of any stretches of an array of letters, from one running sum."""

    def __init__(self, letters):
        up, self.down = _powers(1 << len(letters).bit_length())
        self.sums = np.zeros(len(letters) + 1, np.uint64)
        np.cumsum((letters + np.uint64(1)) * up[: len(letters)], out=self.sums[1:])

    def __call__(self, a, z):
        h = (self.sums[z] - self.sums[a]) * self.down[a]
        return (h ^ (h >> np.uint64(32))) * _SPREAD


def _stretches(letters, a, z):
    """Arrow strings of stretches of an array of letters."""
    import pyarrow as pa

    ends = np.cumsum(z - a)
    picked = letters[np.repeat(a - ends + (z - a), z - a) + np.arange(ends[-1] if len(ends) else 0)].astype(np.uint32)
    sizes = 1 + (picked > 0x7F) + (picked > 0x7FF) + (picked > 0xFFFF) if len(picked) and picked.max() > 0x7F else np.ones(len(picked), np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], ends])].astype(np.int32)
    return pa.StringArray.from_buffers(len(a), pa.py_buffer(offsets), pa.py_buffer(picked.tobytes().decode("utf-32-le").encode()))


class _Known:
    """The aliases of a class in order of their hashes, behind a bitmap: strings, and which types each has."""

    def __init__(self, strings, types):
        self.strings, self.types = strings, types
        self.hashes = np.concatenate([self._hashes(strings.slice(i, SLICE).to_pylist()) for i in range(0, len(strings), SLICE)])
        order = np.argsort(self.hashes, kind="stable")
        self.hashes, self.strings, self.types = self.hashes[order], strings.take(order), types[order]
        size = int(np.clip(1 << max(0, SPARSE * len(order) - 1).bit_length(), *BITMAP))
        self.shift = np.uint64(64 - size.bit_length() + 1)
        bits = np.zeros(size, bool)
        bits[self.hashes >> self.shift] = True
        self.bits = np.packbits(bits)
        #: Aliases of one hash, at most.
        self.alike = int(np.diff(np.concatenate([np.flatnonzero(np.r_[True, self.hashes[1:] != self.hashes[:-1]]), [len(order)]])).max())

    @staticmethod
    def _hashes(keys: list[str]):
        ends = np.cumsum([len(x) for x in keys])
        return _Hashes(_codes("".join(keys)))(np.concatenate([[0], ends[:-1]]), ends)

    def find(self, letters, hashes, a, z) -> tuple[np.ndarray, np.ndarray]:
        """Which of the stretches from a to z are aliases, and their types: past the bitmap, strings are compared."""
        import pyarrow.compute as pc

        h = hashes(a, z)
        place = h >> self.shift
        left = np.flatnonzero(self.bits[place >> np.uint64(3)] >> (np.uint8(7) - (place & np.uint64(7)).astype(np.uint8)) & 1)
        at = np.searchsorted(self.hashes, h[left])
        hits, types = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for _ in range(self.alike):
            same = np.flatnonzero(self.hashes[np.minimum(at, len(self.hashes) - 1)] == h[left])
            left, at = left[same], at[same]
            equal = pc.equal(_stretches(letters, a[left], z[left]), self.strings.take(at)).to_numpy(zero_copy_only=False)
            hits.append(left[equal])
            types.append(self.types[at[equal]])
            left, at = left[~equal], at[~equal] + 1
            kept = at < len(self.hashes)
            left, at = left[kept], at[kept]
        return np.concatenate(hits), np.concatenate(types)


def _found(texts, known: dict[str, _Known], shapes: list[tuple]):
    """Which text, start, end, types and string of every place taken, in order; and the years. The texts, Arrow strings, are one array of letters."""
    import pyarrow as pa
    import pyarrow.compute as pc

    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), "\n")[0].as_py()
    codes, sizes = _codes(f"\n{joined}\n"), pc.utf8_length(texts).to_numpy() + 1
    first = np.concatenate([[1], 1 + np.cumsum(sizes, dtype=np.int64)])
    sizes[:1] += 1
    row = np.repeat(np.arange(len(texts)), sizes)  # the text that a letter is in
    letters = _letters()
    letters.learn(codes)
    found, kinds = [], (EXACT, LOWER, FOLDED)
    token = letters.token[codes]
    tokens = _runs(token)
    for rank, kind in enumerate(kinds):
        if kind not in known:
            continue
        if kind == FOLDED:
            plain = letters.plain[codes]
            word = plain != ord(" ")
            starts, ends = _runs(word)
            word[1:] |= word[:-1].copy()
            form = plain[word]  # words with one space after each
            to = np.cumsum(ends - starts + 1) - 1
            of = to - (ends - starts)
        else:
            (starts, ends), form = tokens, letters.low[codes] if kind == LOWER else codes
        hashes, owner = _Hashes(form), row[starts]
        for _, before, n, after in (s for s in shapes if s[0] == kind):
            k = max(0, len(starts) - n + 1)
            if kind == FOLDED:
                at = np.flatnonzero(owner[:k] == owner[n - 1 :])
                hit, types = known[kind].find(form, hashes, of[at], to[at + n - 1])
                a, z = starts[at[hit]], ends[at[hit] + n - 1]
            else:
                a, z, t = starts[:k] - before, ends[n - 1 :] + after, owner[:k]
                at = np.flatnonzero((a >= first[t]) & (z < first[t + 1]))
                a, z = a[at], z[at]
                if before or after:
                    free = ~token[a - 1] & ~token[z]
                    a, z = a[free], z[free]
                hit, types = known[kind].find(form, hashes, a, z)
                a, z = a[hit], z[hit]
            found.append((a, z, np.full(len(a), rank), types))
    a, z, rank, types = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4
    order = np.lexsort((rank, -z, a))
    a, z, rank, types = a[order], z[order], rank[order], types[order]
    # Places that touch no other are taken; the rest are chosen from, those that hang together at a time.
    group = np.flatnonzero(np.r_[True, a[1:] >= np.maximum.accumulate(z)[:-1]][: len(a)])
    many = np.diff(np.r_[group, len(a)])
    taken = np.zeros(len(a), bool)
    taken[group[many == 1]] = True
    two = group[many == 2]  # codes of one class: the first; else the longer one
    second = (z[two + 1] - a[two + 1] > z[two] - a[two]) & ((rank[two] != rank[two + 1]) | (rank[two] == kinds.index(FOLDED)))
    taken[two + second] = True
    for i, n in zip(group[many > 2].tolist(), many[many > 2].tolist(), strict=True):
        base = int(a[i])
        some = zip(rank[i : i + n].tolist(), (a[i : i + n] - base).tolist(), (z[i : i + n] - base).tolist(), range(i, i + n), strict=True)
        taken[[x for _, _, x in chosen([(kinds[r], y, w, x) for r, y, w, x in some])]] = True
    a, z, types = a[taken], z[taken], types[taken]
    owner = row[a]
    return (owner, a - first[owner], z - first[owner], types, _stretches(codes, a, z)), _years(codes, row)


def _years(codes, row) -> tuple[np.ndarray, np.ndarray]:
    """Which text and year of every year, distinct and in order: runs of four digits that begin with 20."""
    starts, ends = _runs((codes >= ord("0")) & (codes <= ord("9")))
    at = starts[ends - starts == 4]
    digits = codes[at[:, None] + np.arange(4)].astype(np.int64) - ord("0")
    year = digits @ [1000, 100, 10, 1]
    owner, year = np.divmod(np.unique((row[at] * 10_000 + year)[year // 100 == 20]), 10_000)
    return owner, year


def _by_list(rows: DataFrame, keys: DataFrame, shapes: list[tuple], written: bool) -> DataFrame:
    table = keys.select("cls", "key", F.to_json("types").alias("types")).toArrow()
    coded = table.column("types").combine_chunks().dictionary_encode()
    kinds, types = np.array(table.column("cls").to_pylist()), [json.loads(x) for x in coded.dictionary.to_pylist()]
    known = {}
    for kind in (EXACT, LOWER, FOLDED):
        at = np.flatnonzero(kinds == kind)
        if len(at):
            known[kind] = _Known(table.column("key").combine_chunks().take(at), coded.indices.to_numpy()[at].astype(np.int64))
    forms = rows.sparkSession.sparkContext.broadcast((known, types))

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        known, types = forms.value
        types, named = pa.array(types, pa.list_(pa.string())), pa.array(["+".join(t) for t in types], pa.string())
        for b in batches:
            sizes = np.cumsum(pc.binary_length(b.column("text")).to_numpy().astype(np.int64) + 1)
            i = 0
            while i < b.num_rows:
                n = max(1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + LOOKED_UP, "right")) - i)
                part = b.slice(i, n)
                (owner, a, z, of, strings), (dated, year) = _found(part.column("text"), known, shapes)
                a, z, of = pa.array(a, pa.int32()), pa.array(z, pa.int32()), pa.array(of)
                if written:
                    places = pc.binary_join_element_wise(a.cast(pa.string()), z.cast(pa.string()), named.take(of), strings, ":")
                else:
                    places = pa.StructArray.from_arrays([strings, a, z, types.take(of)], ["text", "start", "end", "types"])
                lists = [pa.ListArray.from_arrays(pa.array(np.searchsorted(x, np.arange(n + 1)), pa.int32()), y) for x, y in ((owner, places), (dated, pa.array(year, pa.int32())))]
                yield pa.RecordBatch.from_arrays([part.column("id"), *lists], ["id", "mentions", "years"])
                i += n

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, mentions {'array<string>' if written else _MENTIONS}, years array<int>")


def _place(kind: str, key: str, size: int) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(f"{kind} {key}".encode("utf-8", "replace")) & (size - 1)


def _bitmap(keys: DataFrame, n: int) -> bytes:
    """Packed bits, set at the hash of each of n aliases: a filter of bounded size before the join that decides."""
    size = int(np.clip(1 << max(0, SPARSE * n - 1).bit_length(), *BITMAP))

    def run(batches):
        import pyarrow as pa

        bits = np.zeros(size, bool)
        for b in batches:
            bits[[_place(*x, size) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]] = True
        yield pa.RecordBatch.from_pydict({"bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    out = np.zeros(size // 8, np.uint8)
    for r in keys.select("cls", "key").coalesce(4).mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(r["bits"], np.uint8)
    return out.tobytes()


def _by_join(rows: DataFrame, keys: DataFrame, n: int, shapes: list[tuple]) -> DataFrame:
    bitmap = rows.sparkSession.sparkContext.broadcast(_bitmap(keys, n))

    def run(batches):
        import pyarrow as pa

        bits = bitmap.value
        size = 8 * len(bits)
        kind = pa.list_(pa.struct([("cls", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("key", pa.string())]))
        for b in batches:
            for i in range(b.num_rows):
                found = []
                for cls, a, z, key in windows(b.column("text")[i].as_py(), shapes):
                    at = _place(cls, key, size)
                    if bits[at >> 3] >> (7 - (at & 7)) & 1:
                        found.append({"cls": cls, "start": a, "end": z, "key": key})
                yield pa.RecordBatch.from_arrays([b.column("id").slice(i, 1), b.column("text").slice(i, 1), pa.array([found], kind)], ["id", "text", "w"])

    kind = rows.schema["id"].dataType.simpleString()
    runs = rows.mapInArrow(run, f"id {kind}, text string, w array<struct<cls: string, start: int, end: int, key: string>>")
    runs = runs.select("id", F.xxhash64("text").alias("h"), F.md5("text").alias("m"), F.inline("w"))
    # Repeated rows have the same places.
    hits = runs.join(keys, ["cls", "key"]).groupBy("id", "h", "m").agg(F.collect_set(F.struct("cls", "start", "end", "types")).alias("found"))
    pick = F.udf(lambda text, found: [(text[a:z], a, z, t) for a, z, t in chosen([tuple(f) for f in found or ()])], _MENTIONS)
    a, b = rows.withColumns({"h": F.xxhash64("text"), "m": F.md5("text")}).alias("a"), hits.alias("b")
    joined = a.join(b, F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.h") == F.col("b.h")) & (F.col("a.m") == F.col("b.m")), "left")
    return joined.select("a.id", "a.text", pick("a.text", "b.found").alias("mentions"))
