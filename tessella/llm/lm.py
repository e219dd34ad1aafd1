"""LM scoring: the likelihood of a text under a lattice of words and subword pieces, summed over all segmentations."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm._common import cleared, crc_fold, dropped, filesystem, saved, scratch, write_whole

FOLDS, VOCABULARY = 10, "piece_bpe_32k.model"
#: Bytes of text in a block: a block's distinct words and their scores are one task's dictionary.
BLOCK_BYTES = 24 << 20
#: A word's places are rows of the blocks of 2 ** SLICE_BITS tasks each.
SLICE_BITS = 5
#: Added to each piece's count.
PIECE_ADD = 0.05
#: Classes of texts (languages) that get word edges of their own.
MAX_CLASSES = 8
#: What sentencepiece writes for the space before a word.
START = "▁"


def load_pieces(model: str):
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))


def vocabulary(model: str) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """Pieces by text, the ids of the 256 byte pieces, and a prior from the vocabulary's own scores.

    The file's scores are the negative ranks of its pieces; a piece of rank r weighs 1 / (r + 3), by Zipf's law.
    """
    sp = load_pieces(model)
    n = sp.get_piece_size()
    byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
    skip = {*byte_ids.tolist(), *(i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
    pieces = {sp.id_to_piece(i): i for i in range(n) if i not in skip}
    scores = np.array([sp.get_score(i) for i in range(n)])
    prior = 1 / (scores.max() - scores + 3)
    prior[[i for i in skip if i not in set(byte_ids.tolist())]] = 0
    return pieces, byte_ids, prior / prior.sum()


class Lattice:
    """log_p(word): natural log of the summed probability of all segmentations of a word into pieces."""

    def __init__(self, pieces: dict[str, int], byte_ids: np.ndarray, log_weights: np.ndarray):
        self.weights = {k: float(log_weights[i]) for k, i in pieces.items()}
        self.byte_weights = [float(log_weights[i]) for i in byte_ids]
        self.longest = max(map(len, pieces), default=1)

    def log_p(self, word: bytes) -> float:
        s = START + word.decode("utf-8", "replace")
        n, get, log1p, exp = len(s), self.weights.get, math.log1p, math.exp
        reach: list[float | None] = [None] * (n + 1)
        reach[0] = 0.0
        for i in range(n):
            a = reach[i]
            if a is None:
                continue
            for j in range(i + 1, min(n, i + self.longest) + 1):
                w = get(s[i:j])
                if w is None:
                    if j > i + 1:
                        continue
                    # Any character can be spelt by its bytes; where it is a piece too, that spelling is a path as well.
                    w = sum(self.byte_weights[b] for b in s[i:j].encode())
                x, y = a + w, reach[j]
                if y is None:
                    reach[j] = x
                elif x > y:
                    reach[j] = x + log1p(exp(y - x))
                else:
                    reach[j] = y + log1p(exp(x - y))
        return reach[n]


def _classes(documents: DataFrame, column: str | None) -> list:
    """The values of `column` with the most training rows, MAX_CLASSES of them; all other rows form one more class."""
    if column not in documents.columns:
        return []
    top = documents.where(crc_fold("doc_id", FOLDS) != 0).where(F.col(column).isNotNull()).groupBy(column).count()
    return [r[0] for r in top.orderBy(F.desc("count"), column).limit(MAX_CLASSES).collect()]


def _planes(ids: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers byte plane by byte plane: the high planes are nearly all zero and compress away."""
    return ids.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _blocks(documents: DataFrame, id_type: T.DataType, block_bytes: int, column: str | None, classes: list) -> DataFrame:
    """The texts in blocks, as numbers of their words, and each block's words with number and training counts by class: one written table.

    Both kinds of rows come from the same run of the same task, so that numbers and words agree, whatever is run again.
    """
    schema = T.StructType([
        T.StructField("kind", T.ByteType()), T.StructField("block", T.LongType()), T.StructField("doc_id", id_type), T.StructField("held_out", T.BooleanType()), T.StructField("class", T.ByteType()),
        T.StructField("words", T.BinaryType()), T.StructField("word", T.BinaryType()), T.StructField("number", T.IntegerType()), T.StructField("n", T.ArrayType(T.IntegerType()))])
    kind = F.lit(len(classes))
    for i, c in enumerate(classes):
        kind = F.when(F.col(column) == c, i).otherwise(kind)
    rows = documents.select("doc_id", (crc_fold("doc_id", FOLDS) == 0).alias("held_out"), kind.cast("byte").alias("class"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    width = len(classes) + 1

    def split(batches: Iterable) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        block, held = TaskContext.get().partitionId() << 24, 0
        index: dict[bytes, int] = {}
        counts = np.zeros((1 << 16, width), np.int32)

        def row(kind, size, **known):
            cols = {"kind": pa.array([kind] * size, pa.int8()), "block": pa.array([block] * size, pa.int64())} | known
            return pa.RecordBatch.from_arrays([cols[f.name].cast(f.type) if f.name in cols else pa.nulls(size, f.type) for f in kinds], schema=kinds)

        def vocabulary_of():
            found = list(index)
            for i in range(0, len(found), 50_000):
                some = found[i : i + 50_000]
                n = pa.ListArray.from_arrays(pa.array(np.arange(0, len(some) * width + 1, width), pa.int32()), pa.array(counts[i : i + len(some)].ravel(), pa.int32()))
                yield row(1, len(some), word=pa.array(some, pa.binary()), number=pa.array(np.arange(i, i + len(some)), pa.int32()), n=n)

        for batch in batches:
            out, kind = batch.column("held_out").to_pylist(), batch.column("class").to_pylist()
            packed, first = [], 0
            for i, t in enumerate(batch.column("text")):
                # On bytes, lower() and split() know A-Z and the white space \x20\x09-\x0D alone.
                raw = t.as_buffer().to_pybytes().lower()
                mine = raw.split()
                ids = np.fromiter((index.setdefault(w, len(index)) for w in mine), np.int64, len(mine))
                if len(index) > len(counts):
                    counts = np.concatenate([counts, np.zeros((max(len(counts), len(index) - len(counts)), width), np.int32)])
                if not out[i]:
                    np.add.at(counts[:, kind[i]], ids, 1)
                packed.append(_planes(ids))
                held += len(raw)
                if held >= block_bytes or i + 1 == batch.num_rows:
                    some = batch.slice(first, i + 1 - first)
                    yield row(0, len(some), words=pa.array(packed, pa.binary()), **{c: some.column(c) for c in ("doc_id", "held_out", "class")})
                    packed, first = [], i + 1
                if held >= block_bytes:
                    yield from vocabulary_of()
                    block, held, index = block + 1, 0, {}
                    counts = np.zeros((1 << 16, width), np.int32)
        if index:
            yield from vocabulary_of()

    spark = documents.sparkSession
    rows.mapInArrow(split, schema).write.option("compression", "zstd").parquet(path := scratch(spark, "lm-blocks"))
    return spark.read.schema(schema).parquet(path)


def lm_scores(documents: DataFrame, model: str = VOCABULARY, class_column: str | None = "lang", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of `documents` (doc_id, text).

    Tokens are the text's words and one end. The model is a lattice: an edge for each word learnt from the training
    fold, of probability (c - d) / N, and, with the mass that the discount d takes off, all paths over the pieces of an
    existing vocabulary. Its pieces weigh as often as they occur in the distinct training words, their own scores being
    the prior. The forward recursion over a word runs in log space and sums every path; words and the end are
    independent, so the document's log probability is a sum. Each distinct word is scored once.
    Texts of several languages mix: each class of class_column (a column of `documents`, learnt from training rows only)
    has word edges of its own, discounted towards those of all rows; a text's probability sums over the classes, of
    which the text's own value of that column plays no part.

    Counts cover all training rows and are summed by word in the cluster; no task or driver holds the vocabulary of the
    corpus: texts stand in blocks of bounded bytes, and each block gets the scores of its own words as one file. A word
    that stands in all blocks has its places in many rows of bounded length. What is written on the way is deleted.
    A null text is empty: one end. An empty table gives none. With no training rows N is 0 and the pieces have all mass.
    Repeated rows count as often as they occur. Null ids belong to the fold of an empty text.
    """
    spark = documents.sparkSession
    id_type = documents.schema["doc_id"].dataType
    classes = _classes(documents, class_column)
    width = len(classes) + 1
    blocks = _blocks(documents, id_type, block_bytes, class_column, classes)
    listed = blocks.where("kind = 1")
    sums = [F.sum(F.col("n")[k].cast("long")) for k in range(width)]
    # One shuffle by word serves the slices of its places and its counts over all of them.
    sliced = listed.repartition("word").groupBy("word", F.shiftright("block", 24 + SLICE_BITS).alias("slice"))
    sliced = sliced.agg(F.array(*sums).alias("some"), F.collect_list(F.struct("block", "number")).alias("places"))
    whole = Window.partitionBy("word")
    grouped = sliced.select("word", "places", F.array(*(F.sum(F.col("some")[k]).over(whole) for k in range(width))).alias("by_class"), (F.col("slice") == F.min("slice").over(whole)).alias("leading"))
    words = saved(grouped.withColumn("c", sum(F.col("by_class")[k] for k in range(width))), "lm-words")
    each = words.where("leading")
    class_ends = np.zeros(width)
    for r in blocks.where("kind = 0 AND NOT held_out").groupBy("class").count().collect():
        class_ends[r["class"]] = r["count"]
    ends = int(class_ends.sum())
    sums = each.agg(*(F.coalesce(F.sum(F.col("by_class")[k]), F.lit(0)) for k in range(width)), *(F.count_if(F.col("by_class")[k] > 0) for k in range(width))).first()
    class_words, class_types = np.array(sums[:width], float), np.array(sums[width:], float)
    one = each.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    in_words, types, once, twice = (int(x) for x in one)
    total, distinct = in_words + ends, types + (ends > 0)
    discount = once / (once + 2 * twice) if once and twice else 0.5
    discount = min(max(discount, 0.05), 0.95)

    def count_pieces(batches: Iterable) -> Iterator:
        import pyarrow as pa

        sp = load_pieces(model)
        counts = np.zeros(sp.get_piece_size(), np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 20_000):
                got = sp.encode([w.decode("utf-8", "replace") for w in batch.column("word").slice(i, 20_000).to_pylist()], num_threads=1)
                counts += np.bincount(np.fromiter((x for ids in got for x in ids), np.int64), minlength=len(counts))
        ids = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int32()), "n": pa.array(counts[ids], pa.int64())})

    found = each.where("c > 0").select("word").mapInArrow(count_pieces, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    pieces, byte_ids, prior = vocabulary(model)
    weights = PIECE_ADD * len(prior) * prior
    for r in found.collect():  # at most a row per piece of the vocabulary
        weights[r["id"]] += r["n"] if prior[r["id"]] else 0
    with np.errstate(divide="ignore"):
        log_weights = np.log(weights / weights.sum())
    shared = spark.sparkContext.broadcast((pieces, byte_ids, log_weights))
    spare = math.log(discount * types / total) if types else math.log(0.5)
    end_lp = math.log10(ends / total) if ends else math.log10(0.5)
    floor = total + 0.1 * (distinct + 1)
    used = np.flatnonzero(class_ends) if ends else np.zeros(1, int)
    class_total = class_words + class_ends
    # A class without training rows has no part; with none at all there is one class, and it is the global lattice.
    class_share = np.log10(class_ends[used] / ends) if ends else np.zeros(1)
    class_end = np.log10(class_ends[used] / class_total[used]) if ends else np.array([end_lp])

    def of_classes(counts: np.ndarray, lp: np.ndarray) -> np.ndarray:
        """log10 probabilities by class: an edge of the class's own, and with the mass of its discounts the edge and the paths of
        all rows. (lp is of words and end together; a word alone is asked for here, as classes have ends of their own.)"""
        if not ends:
            return lp[:, None] / math.log(10)
        spread = discount * class_types[used] / class_total[used] * (total / max(in_words, 1))
        own = np.maximum(counts[:, used] - discount, 0) / class_total[used]
        with np.errstate(divide="ignore", under="ignore"):
            far = np.log(spread)[None, :] + lp[:, None]
            return np.maximum(np.where(own > 0, np.log(own + np.exp(far)), far), -1e9) / math.log(10)

    def score_words(batches: Iterable) -> Iterator:
        """Packs, for each block, the numbers, counts and scores of its words among those at hand."""
        import pyarrow as pa

        lattice = Lattice(*shared.value)
        for batch in batches:
            counts = np.array(batch.column("by_class").to_pylist(), np.int64).reshape(batch.num_rows, width)
            lp = np.empty(batch.num_rows)
            for i, (w, c) in enumerate(zip(batch.column("word").to_pylist(), counts.sum(1).tolist(), strict=True)):
                x = spare + lattice.log_p(w)
                if c > 0:
                    y = math.log((c - discount) / total)
                    x = max(x, y) + math.log1p(math.exp(-abs(x - y)))
                lp[i] = x
            places = batch.column("places")
            of = np.repeat(np.arange(batch.num_rows), np.diff(places.offsets.to_numpy()))
            block, number = (places.flatten().field(k).to_numpy() for k in (0, 1))
            order = np.argsort(block, kind="stable")
            block, number, of = block[order], number[order], of[order]
            starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.zeros(0, int)
            ends_ = np.r_[starts[1:], len(block)]
            wide = "<u4" if counts.max(initial=0) < 1 << 32 else "<u8"
            parts = [(int(block[a]), z - a, number[a:z].astype("<u4").tobytes(), counts[of[a:z]].T.astype(wide).tobytes(), lp[of[a:z]].astype("<f4").tobytes()) for a, z in zip(starts.tolist(), ends_.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*parts, strict=True) if parts else [()] * 5, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["block", "size", "numbers", "counts", "lp"])

    folder = scratch(spark, "lm-dictionaries")
    scored = words.select("word", "by_class", "places").mapInArrow(score_words, "block long, size long, numbers binary, counts binary, lp binary")

    def keep(key, table):
        import pyarrow as pa

        sizes = table.column("size").to_pylist()
        n = sum(sizes)
        counts, lp = np.zeros((width, n), np.int64), np.zeros(n, np.float32)
        for size, numbers, c, x in zip(sizes, *(table.column(k).to_pylist() for k in ("numbers", "counts", "lp")), strict=True):
            at = np.frombuffer(numbers, "<u4")
            counts[:, at] = np.frombuffer(c, "<u4" if len(c) == 4 * size * width else "<u8").reshape(width, size)
            lp[at] = np.frombuffer(x, "<f4")
        out = pa.table({"lp": pa.array(lp)} | {f"c{k}": pa.array(counts[k]) for k in range(width)})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_file(sink, out.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(out)
        write_whole(f"{folder}/{key[0].as_py()}.arrow", [sink.getvalue()])
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64())})

    scored.groupBy("block").applyInArrow(keep, "block long").agg(F.count("*")).first()

    out = T.StructType([T.StructField("doc_id", id_type), *(T.StructField(n, t) for n, t in (("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())))])

    def score_texts(batches: Iterable) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds, now = to_arrow_schema(out), None
        end_base = math.log10((ends + 0.1) / floor)
        for batch in batches:
            rows = []
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("words").to_pylist(), strict=True):
                mixed, base_sum, n, known = class_end + class_share, end_base, 1, int(ends > 0)
                if raw:
                    if block != now:
                        system, path = filesystem(f"{folder}/{block}.arrow")
                        with system.open_input_file(path) as f:
                            table = pa.ipc.open_file(f).read_all()
                        counts = np.stack([table.column(f"c{k}").to_numpy() for k in range(width)], axis=1)
                        c, lp = counts.sum(1), of_classes(counts, table.column("lp").to_numpy().astype(np.float64))
                        base, now = np.log10((c + 0.1) / floor), block
                    ids = _from_planes(raw)
                    mixed, base_sum = mixed + lp[ids].sum(0), base_sum + float(base[ids].sum())
                    n, known = n + len(ids), known + int(np.count_nonzero(c[ids]))
                rows.append((n, known, base_sum, float(mixed.max() + np.log10((10 ** (mixed - mixed.max())).sum()))))
            n, known, bases, scores = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array([total] * len(rows), pa.int64()), pa.array(bases, pa.float64()), pa.array(scores, pa.float64())], schema=kinds)

    texts = blocks.where("kind = 0").select("block", "doc_id", "held_out", "words")
    result = saved(texts.mapInArrow(score_texts, out), "lm-scores")
    dropped(words, blocks)
    cleared(spark, folder)
    return result


def op6_lm_score(spark, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
