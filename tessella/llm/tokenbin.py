"""Token-ID output: ids in a canonical, length-limited Huffman code of their global counts, in blocks that decode alone."""

from __future__ import annotations

import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm._common import dropped, filesystem, release, saved, scratch, shuffle_parts, write_whole

TOKENIZER, END_ID = "byte_bpe_50k.json", 2
#: Bits of the longest code (the decoding table has 2 ** MAX_BITS entries), ids in a block, text bytes in a file.
MAX_BITS, BLOCK, FILE_BYTES = 18, 1024, 8 << 20
#: Files at most: the driver keeps a number for each.
MAX_FILES = 400_000
MAGIC = b"TSLHUF01"


# ---------------------------------------------------------------- code


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most max_bits for positive counts (package-merge); a single symbol gets one bit."""
    n = len(counts)
    if n > 1 << max_bits:
        raise ValueError(f"{n} symbols don't fit {max_bits} bits")
    if n == 0:
        return np.zeros(0, np.uint8)
    if n == 1:
        return np.ones(1, np.uint8)
    order = np.argsort(counts, kind="stable")
    leaf = counts[order].astype(np.float64)
    # levels[j]: for the items of a level in order of weight, whether each is a leaf. Packages pair neighbours.
    levels, weights, is_leaf = [], leaf, np.ones(n, bool)
    levels.append(is_leaf)
    for _ in range(max_bits - 1):
        pairs = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaf, pairs])
        at = np.argsort(both, kind="stable")
        weights = both[at]
        levels.append(at < n)
    take, lengths = 2 * n - 2, np.zeros(n, np.int64)
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out = np.zeros(n, np.uint8)
    out[order] = lengths
    return out


def canonical(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The code of each id: ordered by length, then id; codes count up."""
    order = np.lexsort((ids, lengths))
    codes, code, last = np.zeros(len(ids), np.uint64), 0, 0
    ls = lengths[order].astype(int)
    # Within one length codes are consecutive, so each length is one step.
    i = 0
    while i < len(ls):
        j = int(np.searchsorted(ls, ls[i], "right"))
        code <<= ls[i] - last
        codes[order[i:j]] = np.arange(code, code + j - i, dtype=np.uint64)
        code, last, i = code + j - i, ls[i], j
    return codes


class Code:
    """ids (ascending) with code lengths and codes, and the tables for encoding and decoding."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        self.ids, self.lengths = ids.astype(np.uint32), lengths.astype(np.uint8)
        self.codes = canonical(self.ids, self.lengths)
        self.bits = int(self.lengths.max(initial=1))

    def encode(self, tokens: np.ndarray, block: int = BLOCK) -> tuple[bytes, np.ndarray]:
        """The bit string, most significant bit first, and the bit offset at which each block of ids starts."""
        if not len(tokens):
            return b"", np.zeros(0, np.uint64)
        place = np.zeros(int(self.ids[-1]) + 1, np.uint32)
        place[self.ids] = np.arange(len(self.ids))
        out, offsets, done, step = bytearray(), [], 0, block << 10  # in steps of bounded memory
        for i in range(0, len(tokens), step):
            at = place[tokens[i : i + step]]
            size, code = self.lengths[at].astype(np.int64), self.codes[at]
            shift = done & 7  # bits of the byte at hand that the step before took
            ends = np.cumsum(size) + shift
            starts = ends - size
            n = int(ends[-1] + 7) // 8
            # A code of up to 24 bits touches at most two 32-bit words; bits of different codes never overlap, so sums are unions.
            value = code << (64 - size - (starts & 31)).astype(np.uint64)
            word, words = starts >> 5, n // 4 + 2
            total = np.bincount(word, weights=value >> np.uint64(32), minlength=words)
            low = value & np.uint64(0xFFFFFFFF)
            over = np.flatnonzero(low)
            total += np.bincount(word[over] + 1, weights=low[over], minlength=words)
            raw = bytearray(total.astype(">u4").tobytes()[:n])
            if shift:
                raw[0] |= out.pop()
            out += raw
            offsets.append((starts[::block] + (done - shift)).astype(np.uint64))
            done += int(ends[-1]) - shift
        return bytes(out), np.concatenate(offsets)

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """For every pattern of `bits` bits: the index of the id that it starts with, and the bits that its code takes."""
        order = np.lexsort((self.ids, self.lengths))
        span = 1 << (self.bits - self.lengths[order].astype(np.int64))
        index = np.repeat(order, span)
        index = np.pad(index, (0, (1 << self.bits) - len(index)), mode="edge")
        return index.astype(np.uint32), self.lengths[index]

    def decode(self, data: bytes, offsets: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
        """n ids. All blocks advance side by side, one id per step and block: each starts at its own checkpoint."""
        if not n:
            return np.zeros(0, np.uint32)
        index, size = self.table()
        raw = np.frombuffer(data + b"\0" * 8, np.uint8)
        # Window i: the 32 bits from byte i on.
        windows = (raw[:-3].astype(np.uint32) << 24) | (raw[1:-2].astype(np.uint32) << 16) | (raw[2:-1].astype(np.uint32) << 8) | raw[3:]
        blocks = len(offsets)
        out = np.empty((block, blocks), np.uint32)
        at, shift = offsets.astype(np.int64), np.uint32(32 - self.bits)
        full = n // block  # the last block may be short
        for step in range(block):
            live = blocks if step < n - full * block or full == blocks else full
            if not live:
                break
            a = at[:live]
            seen = (windows[a >> 3] << (a & 7).astype(np.uint32)) >> shift
            out[step, :live] = index[seen]
            at[:live] = a + size[seen]
        return self.ids[out.T.ravel()[:n] if full == blocks else np.concatenate([out[:, :full].T.ravel(), out[: n - full * block, full]])]


# ---------------------------------------------------------------- file


def pack_file(code: Code, start: int, doc_ids: list, lengths: np.ndarray, tokens: np.ndarray) -> Iterator[bytes]:
    """MAGIC, a header of sizes, then: ids and lengths of the code, ids and lengths of documents, checkpoints, bits."""
    data, offsets = code.encode(tokens)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    docs = np.array([d or 0 for d in doc_ids], np.int64)
    parts = [zlib.compress(x.tobytes(), 1) for x in (code.ids, code.lengths, known, docs, lengths.astype(np.uint64), offsets)] + [data]
    yield MAGIC + struct.pack("<QQQI", start, len(tokens), len(doc_ids), BLOCK) + struct.pack("<7QI", *map(len, parts), zlib.crc32(data))
    yield from parts


def unpack_file(data: bytes) -> tuple[int, list, np.ndarray, np.ndarray]:
    """start, doc ids, lengths, tokens."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    start, n, _, block = struct.unpack_from("<QQQI", data, 8)
    *sizes, crc = struct.unpack_from("<7QI", data, 36)
    at, parts = 36 + 60, []
    for s in sizes:
        parts.append(data[at : at + s])
        at += s
    if at != len(data) or zlib.crc32(parts[-1]) != crc:
        raise ValueError("a token file that isn't whole")
    ids, bits, known, docs, lengths, offsets = (np.frombuffer(zlib.decompress(p), t) for p, t in zip(parts, (np.uint32, np.uint8, np.uint8, np.int64, np.uint64, np.uint64), strict=False))
    tokens = Code(ids, bits).decode(parts[-1], offsets, n, block) if n else np.zeros(0, np.uint32)
    return start, [int(d) if k else None for d, k in zip(docs, known, strict=True)], lengths.astype(np.int64), tokens


# ---------------------------------------------------------------- tokens

#: ASCII marks that byte-level BPE keeps apart from the letters before them. (Not the apostrophe: it can join them.)
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_HEAD = "\x01"
#: White space, for regular expressions.
_WHITE = "\t\n\x0b\x0c\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _gathered(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs pool[starts : starts + sizes], one after another, and their sizes."""
    shift = (starts - (np.cumsum(sizes) - sizes)).astype(np.int32)
    at = np.repeat(shift, sizes)
    at += np.arange(len(at), dtype=np.int32)
    return pool[at], sizes


def _strings(column) -> list[str]:
    """An Arrow column without nulls as a list; NumPy makes the strings faster than to_pylist."""
    return column.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """Ids of texts by the tokenizers library, column by column: each distinct chunk of a column is encoded once, and not again
    while it stays in memory.

    Byte-level BPE splits a text into pieces before it merges, and a piece ends at a space or line end that stands alone
    between other characters; so such a text's ids are those of its chunks, each with the space before it, and of its line
    ends. A chunk of letters and marks is two pieces, kept as such, so that letters are encoded once whatever follows them. Texts with runs of white space, with the string of a special token
    or with the sign that marks a chunk without a space before it are encoded whole, as are all texts if the tokenizer
    is of another kind. The ids are the same either way. The chunks known are Arrow strings and one array of ids, `memory`
    bytes at most besides those of the column at hand.
    """

    #: Bytes of chunks and their ids in memory, and of text in a column, about.
    MEMORY, COLUMN = 12 << 20, 4 << 20
    #: Pieces that are merged at once: the library's tokens are objects.
    MERGED = 20_000

    def __init__(self, path: str, memory: int = MEMORY):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import pyarrow as pa
        from tokenizers import Tokenizer

        self.t, self.memory = Tokenizer.from_file(path), memory
        # What this class knows of pieces holds for byte-level pre-tokenizers; others get whole texts.
        self.byte_level = type(self.t.pre_tokenizer).__name__ == "ByteLevel" and self.t.normalizer is None and self.t.post_processor is None
        specials = [re.escape(x.content) for x in self.t.get_added_tokens_decoder().values()]
        # Where white space is irregular: at an end (but for the last line's end) or next to other white space.
        self.odd = "|".join([_HEAD, *specials, f"^[{_WHITE}]", f"[{_WHITE}][{_WHITE}]", f"[{_WHITE.replace(chr(10), '')}]$"])
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        letters = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.letters = np.array([letters.get(b, b) for b in range(256)], "<u4")  # the letters that stand for bytes in the model
        self.kind = np.dtype("<u2" if self.t.get_vocab_size() <= 1 << 16 else "<u4")
        self.chunks = pa.array([], pa.string())
        self.sizes, self.pool = np.zeros(0, np.int32), np.zeros(0, self.kind)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.t.encode(text, add_special_tokens=False).ids, self.kind)

    def _merged(self, pieces: list[str]) -> tuple[list[int], list[int]]:
        """The number of ids of each piece, and all ids: the model's own merges, on the letters that stand for bytes."""
        raw, tokenize = [p.encode() for p in pieces], self.t.model.tokenize
        sizes, ids = [], []
        for k in range(0, len(raw), self.MERGED):
            some = raw[k : k + self.MERGED]
            ends = np.cumsum([len(r) for r in some]).tolist()
            spelt = self.letters[np.frombuffer(b"".join(some), np.uint8)].tobytes().decode("utf-32-le")
            a = 0
            for z in ends:
                found = [k.id for k in tokenize(spelt[a:z])]
                sizes.append(len(found))
                ids += found
                a = z
        return sizes, ids

    def _encode_new(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each chunk, and all ids. Letters, marks and a line end are one piece."""
        pieces, whole = [], {}
        for i, c in enumerate(chunks):
            lead, body = ("", c[1:]) if c[:1] == _HEAD else (" ", c)
            if body.isalpha() or (body and not body.strip(_MARKS)):
                pieces.append(lead + body)
            elif c == "\n" or not body:
                pieces.append(body)
            else:
                whole[i] = self.t.encode(lead + body, add_special_tokens=False).ids
                pieces.append("")
        sizes, ids = self._merged(pieces)
        if whole:
            ends = np.cumsum(sizes).tolist()
            parts = [whole[i] if i in whole else ids[e - n : e] for i, (e, n) in enumerate(zip(ends, sizes, strict=True))]
            sizes, ids = list(map(len, parts)), [k for x in parts for k in x]
        return np.array(sizes, np.int32), np.array(ids, self.kind)

    def _split(self, chunks) -> tuple:
        """The chunks of a column with the marks at the end of letters apart: strings, and for each chunk its one or two places in them
        (the second is -1 for none). Marks stand there as a chunk without a space before it."""
        import pyarrow as pa
        import pyarrow.compute as pc

        stems = pc.utf8_rtrim(chunks, characters=_MARKS)
        n = pc.binary_length(stems).to_numpy()
        some = np.flatnonzero(n < pc.binary_length(chunks).to_numpy())
        letters = _strings(stems.take(pa.array(some)))
        alpha = [x.removeprefix(_HEAD).isalpha() for x in letters]
        marks = [_HEAD + c[len(x) :] for c, x, a in zip(_strings(chunks.take(pa.array(some))), letters, alpha, strict=True) if a]
        some = some[alpha] if len(some) else some
        marked = np.zeros(len(chunks), bool)
        marked[some] = True
        first = pc.if_else(pa.array(marked), stems, chunks)
        both = pa.concat_arrays([first, pa.array(marks, pa.string())]).dictionary_encode()
        at = both.indices.to_numpy()
        second = np.full(len(chunks), -1, np.int32)
        second[some] = at[len(chunks) :]
        return both.dictionary, at[: len(chunks)], second

    def _column(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each text of regular white space, and all ids."""
        import pyarrow as pa
        import pyarrow.compute as pc

        lines = pc.binary_join_element_wise(pa.scalar(_HEAD), pc.replace_substring(texts, "\n", f" \n {_HEAD}"), "")
        split = pc.split_pattern(lines, " ")
        coded = split.flatten().dictionary_encode()
        strings, first, second = self._split(coded.dictionary)
        found = pc.index_in(strings, value_set=self.chunks)
        missing = found.is_null()
        at, new = found.fill_null(0).to_numpy().copy(), strings.filter(missing)
        if len(new):
            at[missing.to_numpy(zero_copy_only=False)] = np.arange(len(self.chunks), len(self.chunks) + len(new))
            sizes, ids = self._encode_new(_strings(new))
            self.chunks = pa.concat_arrays([self.chunks, new])
            self.sizes, self.pool = np.concatenate([self.sizes, sizes]), np.concatenate([self.pool, ids])
        # The ids of this column's strings, then of its chunks, in their own order: what the column's places then look up is small.
        upto = np.cumsum(self.sizes) - self.sizes
        pool, sizes = _gathered(self.pool, upto[at], self.sizes[at])
        if self.chunks.nbytes + self.sizes.nbytes + self.pool.nbytes > self.memory:
            self.chunks, self.sizes, self.pool = strings, sizes, pool  # only they stay
        starts = np.cumsum(sizes) - sizes
        pieces = np.stack([first, second], axis=1).ravel()
        own = np.where(pieces < 0, 0, sizes[pieces])
        pool, _ = _gathered(pool, starts[pieces], own)
        sizes = own.reshape(-1, 2).sum(1)
        chunk = coded.indices.to_numpy()
        ids, size = _gathered(pool, (np.cumsum(sizes) - sizes)[chunk], sizes[chunk])
        upto = np.r_[0, np.cumsum(size)]
        return np.diff(upto[split.offsets.to_numpy()]), ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The unsigned ids of each text: of two bytes if the vocabulary allows, else of four."""
        import pyarrow as pa
        import pyarrow.compute as pc

        column = pa.array(texts, pa.string())
        odd = pc.match_substring_regex(column, self.odd).to_numpy(zero_copy_only=False) if self.byte_level else np.ones(len(texts), bool)
        out: list = [None] * len(texts)
        rest = np.flatnonzero(~odd)
        if len(rest):
            sizes, ids = self._column(column.take(pa.array(rest)))
            for i, x in zip(rest.tolist(), np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
                out[i] = x
        for i in np.flatnonzero(odd).tolist():
            out[i] = self._whole(texts[i])
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str, memory: int) -> Encoder:
    """One per Python worker, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    _encoders[path].memory = memory
    return _encoders[path]


def _bounds(documents: DataFrame, file_bytes: int) -> np.ndarray:
    """Document ids that part the table into ranges of about file_bytes text. An id that is repeated often comes twice or more.

    The sizes are parted by ranges of ids; each range's sums start where the one before it ends, and an id that takes
    the sum over a multiple of a file's share ends a file. The driver gets a number for each range and each file.
    """
    spark = documents.sparkSession
    # A document's id, length and end count too, so that files of empty texts are bounded.
    size = F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))) + 16
    known = saved(documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), size.cast("long").alias("n")), "token-sizes")
    total = known.agg(F.sum("n")).first()[0] or 0
    parts = int(max(1, min(MAX_FILES, -(-total // file_bytes))))
    if parts == 1:
        dropped(known)
        return np.zeros(0, np.int64)
    ranged = saved(known.repartitionByRange(shuffle_parts(spark), "doc_id").withColumn("range", F.spark_partition_id()), "token-ranges")
    before = {r["range"]: r["n"] for r in ranged.groupBy("range").agg(F.sum("n").alias("n")).collect()}
    starts = spark.createDataFrame([(k, sum(before[x] for x in before if x < k)) for k in before], "range int, start long")
    upto = Window.partitionBy("range").orderBy("doc_id", "n").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.join(starts, "range").withColumn("upto", F.col("start") + F.sum("n").over(upto))
    share = -(-total // parts)
    ends = placed.where(F.expr(f"upto div {share} > (upto - n) div {share}")).select("doc_id").collect()
    dropped(known, ranged)
    return np.sort(np.array([r["doc_id"] for r in ends], np.int64))


def write_tokens(documents: DataFrame, folder: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, max_bits: int = MAX_BITS, file_bytes: int = FILE_BYTES, memory: int = Encoder.MEMORY) -> DataFrame:
    """Writes the ids of all texts, each with end_id after it, as folder/part-*.huf in ascending doc_id; returns the files' table (path).

    Null ids come first; rows of one id stand together, ordered by their ids' number and bytes. A null text is empty. An
    empty table writes no file. `memory` bounds the encoders' memory of encoded chunks; ids don't depend on it. There are
    MAX_FILES files at most, which grow beyond file_bytes then. The encoded documents are a written table, many to a row,
    that also has each task's counts by id and by file: these make the code and the files' starts; one shuffle then
    brings the documents of a file together.
    """
    import public_tokenizers

    spark = documents.sparkSession
    path = tokenizer if "/" in tokenizer else public_tokenizers.path(tokenizer)
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bounds = _bounds(documents, file_bytes)
    parts = len(bounds) + 1
    cuts = spark.sparkContext.broadcast(bounds)

    def parts_of(ids: list, texts: list[str]) -> np.ndarray:
        known = np.array([i or 0 for i in ids], np.int64)
        lo, hi = np.searchsorted(cuts.value, known, "left"), np.searchsorted(cuts.value, known, "right")
        for i in np.flatnonzero(hi - lo > 1).tolist():
            lo[i] += zlib.crc32(texts[i].encode("utf-8", "replace")) % (hi[i] - lo[i])
        return np.where([i is None for i in ids], 0, lo)

    names = ("docs", "known", "sizes", "ids")

    def tokens(batches: Iterable) -> Iterator:
        import pyarrow as pa

        enc = encoder(path, memory)
        end = np.array([end_id], enc.kind)
        counts, totals = np.zeros(max(enc.t.get_vocab_size(), end_id + 1), np.int64), np.zeros(parts, np.int64)

        def rows(kind: int, part: list[int], *columns: list[bytes]):
            return pa.RecordBatch.from_pydict({"kind": pa.array([kind] * len(part), pa.int32()), "part": pa.array(part, pa.int64())} | {k: pa.array(c, pa.binary()) for k, c in zip(names, columns, strict=True)})

        for batch in batches:
            for some in _columns(batch):
                ids, texts = some.column("doc_id").to_pylist(), some.column("text").to_pylist()
                encoded = enc.encode(texts)
                part = parts_of(ids, texts)
                order = np.argsort(part, kind="stable")
                edges = np.r_[0, np.flatnonzero(np.diff(part[order])) + 1, len(order)].tolist()
                packs = []
                for a, z in zip(edges[:-1], edges[1:], strict=True):
                    mine, p = order[a:z].tolist(), int(part[order[a]])
                    raw = np.concatenate([x for i in mine for x in (encoded[i], end)])
                    counts += np.bincount(raw, minlength=len(counts))
                    totals[p] += len(raw)
                    packs.append((p, np.array([ids[i] or 0 for i in mine], np.int64).tobytes(), bytes(ids[i] is not None for i in mine), np.array([len(encoded[i]) + 1 for i in mine], np.int64).tobytes(), raw.tobytes()))
                del encoded
                if packs:
                    yield rows(0, *map(list, zip(*packs, strict=True)))
        for kind, sums in ((1, counts), (2, totals)):
            at = np.flatnonzero(sums)
            if len(at):
                yield rows(kind, [0], [at.tobytes()], [b""], [sums[at].tobytes()], [b""])
        release()

    store = scratch(spark, "token-ids")
    documents.mapInArrow(tokens, "kind int, part long, docs binary, known binary, sizes binary, ids binary").write.option("compression", "zstd").parquet(store)
    encoded = spark.read.schema("kind int, part long, docs binary, known binary, sizes binary, ids binary").parquet(store)

    def summed(batches: Iterable) -> Iterator:
        import pyarrow as pa

        sums = np.zeros(0, np.int64)
        for batch in batches:
            for at, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = np.frombuffer(at, np.int64)
                sums = np.pad(sums, (0, max(0, int(at[-1]) + 1 - len(sums))))
                sums[at] += np.frombuffer(n, np.int64)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int64()), "n": pa.array(sums[at], pa.int64())})

    def sums_of(kind: int) -> tuple[np.ndarray, np.ndarray]:
        """On the driver: a number for each id of the vocabulary, or for each file."""
        tasks = encoded.where(F.col("kind") == kind).select("docs", "sizes").coalesce(spark.sparkContext.defaultParallelism)
        got = tasks.mapInArrow(summed, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
        at, n = (np.array([r[k] for r in got], np.int64) for k in (0, 1))
        order = np.argsort(at)
        return at[order], n[order]

    ids, counts = sums_of(1)
    code = Code(ids, code_lengths(counts, max_bits))
    totals = np.zeros(parts, np.int64)
    at, n = sums_of(2)
    totals[at] = n
    shared = spark.sparkContext.broadcast((code.ids, code.lengths, np.cumsum(totals) - totals))

    def write(key, table):
        import pyarrow as pa

        _encoders.clear()  # the workers go on to other work: the chunks in memory were for the texts
        ids, lengths, starts = shared.value
        part = key[0].as_py()
        joined = {k: b"".join(x.as_buffer() for x in table.column(k)) for k in names}
        sizes, known = np.frombuffer(joined["sizes"], np.int64), np.frombuffer(joined["known"], np.uint8)
        docs = [d if k else None for d, k in zip(np.frombuffer(joined["docs"], np.int64).tolist(), known.tolist(), strict=True)]
        raw = np.frombuffer(joined["ids"], f"<u{len(joined['ids']) // int(sizes.sum())}")
        ends = np.cumsum(sizes)
        own = lambda i: raw[ends[i] - sizes[i] : ends[i]]
        repeated = {d for d, n in Counter(docs).items() if n > 1}
        key = lambda i: (docs[i] is not None, docs[i] or 0, *((int(sizes[i]), own(i).tobytes()) if docs[i] in repeated else ()))
        order = sorted(range(len(docs)), key=key)
        uri = f"{folder}/part-{part:07d}.huf"
        write_whole(uri, pack_file(Code(ids, lengths), int(starts[part]), [docs[i] for i in order], sizes[order], np.concatenate([own(i) for i in order])))
        release()
        return pa.table({"path": pa.array([uri])})

    files = saved(encoded.where("kind = 0").select("part", *names).groupBy("part").applyInArrow(write, "path string"), "token-files")
    dropped(encoded)
    return files


def _columns(batch) -> Iterator:
    """The batch in slices of about Encoder.COLUMN bytes of text."""
    import pyarrow.compute as pc

    upto = np.cumsum(pc.binary_length(batch.column("text")).to_numpy()) // Encoder.COLUMN
    edges = np.r_[0, np.flatnonzero(np.diff(upto)) + 1, batch.num_rows].tolist()
    for a, z in zip(edges[:-1], edges[1:], strict=True):
        if z > a:
            yield batch.slice(a, z - a)


def read_tokens(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) of every document in the files; start counts the ids of all files."""
    n = max(1, files.count())

    def read(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for uri in batch.column("path").to_pylist():
                system, path = filesystem(uri)
                with system.open_input_stream(path, compression=None) as f:
                    start, docs, lengths, tokens = unpack_file(f.read())
                ends = np.cumsum(lengths)
                for i in range(0, len(docs), 2000):
                    some = slice(i, i + 2000)
                    a, z = ends[some] - lengths[some], ends[some]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(docs[some], pa.int64()), "start": pa.array(start + a, pa.int64()), "n_tokens": pa.array(lengths[some], pa.int64()), "ids": pa.array([tokens[x:y].astype("<u4").tobytes() for x, y in zip(a, z, strict=True)], pa.binary())})

    tasks = min(n, 4 * files.sparkSession.sparkContext.defaultParallelism)
    return files.select("path").repartition(tasks, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def op7_token_output(spark, sf_dir: str) -> DataFrame:
    files = write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch(spark, "tokens"))
    return read_tokens(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
