"""Phrase collocations: n-gram counts from word-id suffix arrays of shards, merged by key, then scored by their weakest cut."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm._common import dropped, release, saved

#: Bytes of text in one suffix array, and bytes of text of the whole table for each bucket of keys.
SHARD, BUCKET = 8 << 20, 4 << 20
#: Parts of a language's phrases, of each of which the first ones are taken before all are ranked.
PARTS = 64
#: Kinds of bytes: of words, between words, between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MIX = np.uint64(0x9E3779B97F4A7C15)


def suffix_array(seq: np.ndarray, depth: int) -> np.ndarray:
    """Positions of a word-id sequence in the order of the first `depth` words from there (0 beyond the end), by prefix doubling."""
    rank, k = seq.astype(np.int64), 1
    while k < depth:
        after = np.zeros_like(rank)
        after[:-k] = rank[k:]
        order = np.argsort(key := rank * (int(rank.max(initial=0)) + 1) + after, kind="stable")
        new = np.zeros_like(rank)
        new[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
        rank, k = new + 1, 2 * k
    return np.argsort(rank, kind="stable")


def common_prefixes(seq: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix, the words (up to `depth`, none beyond a 0) that it has in common with the one before it in order."""
    lcp, same = np.zeros(len(order), np.int64), np.ones(max(0, len(order) - 1), bool)
    padded = np.concatenate([seq, np.zeros(depth, seq.dtype)])
    for j in range(depth):
        word = padded[order + j]
        same &= (word[1:] == word[:-1]) & (word[1:] != 0)
        lcp[1:] += same
    return lcp


def ngram_counts(seq: np.ndarray, live: np.ndarray, depth: int):
    """n, positions, counts for n = 1 to depth: an occurrence of each distinct n-gram without a 0, and how often it starts at a live position."""
    order = suffix_array(seq, depth)
    order = order[live[order]]
    lcp = common_prefixes(seq, order, depth)
    ends = np.append(np.flatnonzero(seq == 0), len(seq))
    left = ends[np.searchsorted(ends, order)] - order  # words up to the next 0
    for n in range(1, depth + 1):
        heads = np.flatnonzero(lcp < n)
        counts = np.diff(np.append(heads, len(order)))
        whole = left[heads] >= n
        yield n, order[heads[whole]], counts[whole]


def _parts(text: bytes, depth: int, limit: int):
    """A text in parts of about `limit` bytes, each with the bytes of it whose words start n-grams; cut between pieces, or else between words with the next words added."""
    at = 0
    while len(text) - at > limit:
        kinds = _KIND[np.frombuffer(text, np.uint8, limit, at)]
        gaps = np.flatnonzero(kinds == 2)
        if len(gaps):
            cut = at + int(gaps[-1]) + 1
            yield text[at:cut], cut - at
        else:
            gaps = np.flatnonzero(kinds == 1)
            cut = at + int(gaps[-1]) + 1 if len(gaps) else _next_gap(text, at + limit)
            end = cut
            for _ in range(depth - 1):
                while end < len(text) and _KIND[text[end]] == 1:
                    end += 1
                end = _next_gap(text, end)
            yield text[at:end], cut - at
        at = cut
    yield text[at:], len(text) - at


def _next_gap(text: bytes, at: int) -> int:
    while at < len(text) and not _KIND[text[at]]:
        at += 1
    return at


def words_of(parts: list[tuple[bytes, int]]):
    """Of parts of texts: their words as Arrow strings, each with whether a piece ends before it, and whether it may start an n-gram."""
    import pyarrow as pa

    raw = np.frombuffer(b"\n".join(p for p, _ in parts), np.uint8)
    kinds = _KIND[raw]
    word = np.concatenate([[False], kinds == 0, [False]])
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[::2], edges[1::2]
    breaks = np.cumsum(kinds == 2)[starts] if len(starts) else starts
    new_piece = np.concatenate([[True], breaks[1:] != breaks[:-1]]) if len(starts) else np.zeros(0, bool)
    begin = np.cumsum([0, *[len(p) + 1 for p, _ in parts]])[:-1]
    own = begin + np.array([n for _, n in parts])
    live = starts < own[np.searchsorted(begin, starts, "right") - 1]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    data = _LOWER[raw[kinds == 0]]
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())]), new_piece, live


def shard_counts(parts: list[tuple[bytes, int]], depth: int, buckets: int):
    """bucket, phrases, counts of one shard of texts of one language.

    The phrases of a bucket are UTF-8, words joined by blanks, each phrase ended by a line feed (which no word holds); the
    bucket of a phrase follows from its words alone. Only buckets that occur are given.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    words, new_piece, live = words_of(parts)
    if not len(words):
        return
    coded = words.dictionary_encode()
    rank = pc.sort_indices(coded.dictionary).to_numpy()
    vocabulary = coded.dictionary.take(pa.array(rank))
    ids = np.empty(len(rank), np.int64)
    ids[rank] = np.arange(1, len(rank) + 1)
    at = np.arange(len(words)) + np.cumsum(new_piece) - 1  # a 0 between pieces
    seq, lives = np.zeros(int(at[-1]) + 1, np.int64), np.zeros(int(at[-1]) + 1, bool)
    seq[at], lives[at] = ids[coded.indices.to_numpy()], live
    hashes = np.array([zlib.crc32(w) for w in vocabulary.to_pylist()], np.uint64)
    last = pc.binary_join_element_wise(vocabulary, pa.scalar(b"\n", vocabulary.type), pa.scalar(b"", vocabulary.type))
    for n, where, counts in ngram_counts(seq, lives, depth):
        if not len(where):
            continue
        h = np.full(len(where), n, np.uint64)
        for j in range(n):
            h = (h ^ hashes[seq[where + j] - 1]) * _MIX
            h ^= h >> np.uint64(29)
        bucket = (h % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")  # within a bucket, phrases stay in the order of the suffix array
        where, counts, bucket = where[order], counts[order], bucket[order]
        columns = [(vocabulary if j < n - 1 else last).take(pa.array(seq[where + j] - 1)) for j in range(n)]
        phrases = columns[0] if n == 1 else pc.binary_join_element_wise(*columns, pa.scalar(b" ", vocabulary.type))
        phrases = phrases.combine_chunks() if isinstance(phrases, pa.ChunkedArray) else phrases
        offsets = np.frombuffer(phrases.buffers()[1], np.int64, len(phrases) + 1, 8 * phrases.offset)
        heads = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        for a, z in zip(heads.tolist(), [*heads[1:].tolist(), len(bucket)], strict=True):
            yield int(bucket[a]), n, phrases.buffers()[2][int(offsets[a]) : int(offsets[z])], counts[a:z]


def _pack(n: int, phrases, counts: np.ndarray) -> bytes:
    """One byte n, the number of phrases, the raw size, and counts and phrases compressed."""
    import pyarrow as pa

    raw = counts.astype("<u4").tobytes() + bytes(phrases)
    return bytes([n]) + len(counts).to_bytes(4, "little") + len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(packed: bytes):
    import pyarrow as pa

    n, rows, size = packed[0], int.from_bytes(packed[1:5], "little"), int.from_bytes(packed[5:13], "little")
    raw = pa.decompress(packed[13:], size, codec="zstd", asbytes=True)
    return n, np.frombuffer(raw, "<u4", rows), raw[4 * rows :]


def phrase_counts(docs: DataFrame, depth: int, least: int, lang_col: str = "lang", text_col: str = "text", shard: int = SHARD, per_bucket: int = BUCKET) -> DataFrame:
    """lang, phrase, n_words, f: every phrase of 1 to `depth` words that occurs `least` times or more in its language; and rows of n_words 0, whose f sums to all words of the language.

    Each task builds suffix arrays over `shard` bytes of text a time and sends each bucket's phrases and counts as packed
    rows; a phrase has one entry a shard at most, however common it is. All entries of a bucket meet in one task, with
    about `per_bucket` bytes of text to each bucket and language whatever the table's size.
    """
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    buckets = max(1, -(-size // per_bucket))

    def count(batches):
        import pyarrow as pa

        schema = pa.schema([("lang", pa.string()), ("bucket", pa.int64()), ("packed", pa.binary())])
        held, held_bytes = {}, 0

        def flush():
            for lang, parts in held.items():
                rows, got = [], 0
                for bucket, n, phrases, counts in shard_counts(parts, depth, buckets):
                    rows.append((lang, bucket, _pack(n, phrases, counts)))
                    got += len(rows[-1][2])
                    if got > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows, got = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        for b in batches:
            for lang, text in zip(b.column(0), b.column(1), strict=True):
                if not (raw := (text.as_py() or "").encode()):
                    continue
                for part in _parts(raw, depth, shard):
                    held.setdefault(lang.as_py(), []).append(part)
                    held_bytes += len(part[0])
                    if held_bytes >= shard:
                        yield from flush()
                        held, held_bytes = {}, 0
        yield from flush()
        held = {}
        release()

    def merge(key, table):
        import pyarrow as pa
        import pyarrow.compute as pc

        by_n: dict[int, list] = {}
        for packed in table.column("packed"):
            n, counts, raw = _unpack(packed.as_py())
            by_n.setdefault(n, []).append((counts, raw))
        out, total = [], 0
        for n, entries in sorted(by_n.items()):
            raw = b"".join(r for _, r in entries)
            ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)
            # Each phrase keeps its line feed, so that its bytes follow one another; it is cut off from those that stay.
            phrases = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends + 1]).astype(np.int64).tobytes()), pa.py_buffer(raw)])
            counts = np.concatenate([c for c, _ in entries]).astype(np.int64)
            total += int(counts.sum()) if n == 1 else 0
            summed = pa.table({"p": phrases, "f": counts}).group_by("p").aggregate([("f", "sum")])
            summed = summed.filter(pc.greater_equal(summed.column("f_sum"), least))
            out += [(p[:-1].decode(), n, f) for p, f in zip(summed.column("p").to_pylist(), summed.column("f_sum").to_pylist(), strict=True)]
        out.append((None, 0, total))
        phrase, n_words, f = zip(*out, strict=True)
        return pa.table({"lang": pa.array([key[0].as_py()] * len(out), pa.string()), "phrase": pa.array(phrase, pa.string()), "n_words": pa.array(n_words, pa.int32()), "f": pa.array(f, pa.int64())})

    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    return texts.mapInArrow(count, "lang string, bucket long, packed binary").groupBy("lang", "bucket").applyInArrow(merge, "lang string, phrase string, n_words int, f long")


def collocations(docs: DataFrame, shortest: int = 2, longest: int = 3, least: int = 10, inside: int = 50, top: int = 2000, lang_col: str = "lang", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of each language the `top` phrases by score, count and phrase.

    Texts are lower-cased (A-Z), cut into pieces at .,;:!? and line ends, and pieces into words at blanks and tabs. A
    candidate has `shortest` to `longest` words and a count a of `least` or more. Each cut has the score
    1,000,000 * a * a / (l * r), in whole numbers of 38 digits, with the counts of its two parts; the lowest counts, ties to the
    shortest first part. Candidates inside a longer one that occurs in `inside` percent of their places or more are left out.

    A null language is `und`; null and empty texts have no words; repeated rows count each time; ids aren't read, nor are
    other columns. Texts of any length are cut into parts without losing a phrase. An empty table gives no row.
    """
    grams = saved(phrase_counts(docs, longest, least, lang_col, text_col, shard), "phrases")
    totals = grams.where("n_words = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    parts = grams.where("n_words > 0").select("lang", "phrase", "f")
    found = grams.where(F.col("n_words") >= shortest).select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words"), "n_words")
    joined = lambda first, count: F.array_join(F.slice("words", first, count), " ")
    cuts = found.select("lang", "phrase", "a", "words", "n_words", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(1, F.col("k")).alias("first"), joined(F.col("k") + 1, F.col("n_words") - F.col("k")).alias("rest"))
    sides = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    sides = sides.join(parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    whole = lambda c: f"cast({c} AS decimal(19, 0))"
    sides = sides.withColumn("score", F.expr(f"(cast(1000000 AS decimal(7, 0)) * cast({whole('a')} * {whole('a')} AS decimal(31, 0))) div ({whole('l')} * {whole('r')})"))
    lowest = sides.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    longer = found.where(F.col("n_words") > shortest).select("lang", "a", "words", "n_words", F.explode(F.sequence(F.lit(shortest), F.col("n_words") - 1)).alias("count"))
    longer = longer.select("lang", "a", "words", "count", F.explode(F.sequence(F.lit(1), F.col("n_words") - F.col("count") + 1)).alias("first"))
    longer = longer.groupBy("lang", joined(F.col("first"), F.col("count")).alias("phrase")).agg(F.max("a").alias("most"))
    kept = lowest.join(longer, ["lang", "phrase"], "left").where(F.col("most").isNull() | (F.lit(100) * F.col("most") < F.lit(inside) * F.col("a")))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    ranked = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("a"), "phrase"))
    # The first of each part of a language, so that what meets in one task has a bound whatever the number of tasks before.
    best = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn("rank", ranked("lang", "part")).where(F.col("rank") <= top)
    best = best.drop("part").withColumn("rank", ranked("lang")).where(F.col("rank") <= top)
    out = saved(best.join(totals, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score"), "collocations")
    dropped(grams)
    return out


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, doc, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]+')) AS piece
    FROM (SELECT lang, text, row_number() OVER () AS doc FROM documents)),
texts AS (SELECT lang, w FROM (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces) WHERE len(w) > 0),
grams AS (
    SELECT lang, m, phrase, count(*) AS f
    FROM (SELECT lang, m, unnest(list_transform(generate_series(1, len(w) - m + 1), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM texts, (VALUES (1), (2), (3)) AS t(m) WHERE len(w) >= m)
    GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE m = 1 GROUP BY lang),
found AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE m >= 2 AND f >= 10),
cuts AS (
    SELECT c.lang, c.m, c.phrase, c.a, k, p.f AS l, q.f AS r, (1000000::HUGEINT * c.a * c.a) // (p.f::HUGEINT * q.f) AS score
    FROM (SELECT *, unnest(generate_series(1, m - 1)) AS k FROM found) c
    JOIN grams p ON p.lang = c.lang AND p.phrase = array_to_string(c.w[1:k], ' ')
    JOIN grams q ON q.lang = c.lang AND q.phrase = array_to_string(c.w[k + 1:], ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
    SELECT lang, phrase, max(a) AS most
    FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM found WHERE m = 3) GROUP BY ALL),
kept AS (SELECT b.* FROM lowest b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase WHERE g.most IS NULL OR 100 * g.most < 50 * b.a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept k JOIN totals t ON t.lang = k.lang
QUALIFY rank <= 2000
"""
