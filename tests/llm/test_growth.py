"""What must hold when tables grow: parts in several slices, ranges and blocks give what one part gives; the language model's score by a plain recomputation."""

import math
import random
import zlib
from collections import Counter
from itertools import pairwise

import numpy as np
import pytest

from tessella.llm import jaccard, lm, tokenbin
from tessella.llm._common import scratch, shared_dir

WORDS = [f"{a}{b}" for a in ("water", "Tür", "été", "x", "running") for b in ("", "s", "ed", "ung", "9")]
DOCS = "doc_id long, text string, lang string"


def texts(spark, n=120, seed=5):
    r = random.Random(seed)
    rows = [(i, " ".join(r.choices(WORDS[: 8 + i % 17], k=i % 23)), ("en", "de", "fr", None)[i * i % 4]) for i in range(n)]
    return [*rows, (n, None, "en"), (n + 1, "only once here", "it")]


def plain_scores(rows):
    """The model written down word by word in linear space: classes, discounts and all segmentations of each word."""
    words = lambda t: [w.decode() for w in (t or "").encode().lower().split()]
    train = [(words(t), lang) for i, t, lang in rows if zlib.crc32(str(i).encode()) % lm.FOLDS]
    langs = Counter(lang for _, lang in train if lang is not None)
    named = [k for k, _ in sorted(langs.items(), key=lambda x: (-x[1], x[0]))[: lm.MAX_CLASSES]]
    of = lambda lang: lang if lang in named else None
    count, by = Counter(w for ws, _ in train for w in ws), {}
    for ws, lang in train:
        by.setdefault(of(lang), []).append(ws)
    total = sum(count.values()) + len(train)
    once, twice = (sum(c == k for c in count.values()) for k in (1, 2))
    d = min(max(once / (once + 2 * twice), 0.05), 0.95) if once and twice else 0.5
    sp = lm.load_pieces(lm.VOCABULARY)
    pieces, byte_ids, prior = lm.vocabulary(lm.VOCABULARY)
    seen = Counter(i for w in count for i in sp.encode(w))
    weight = [lm.PIECE_ADD * len(prior) * p + (seen[i] if p else 0) for i, p in enumerate(prior)]
    whole = math.fsum(weight)

    def paths(s, known):
        if s not in known:
            total_ = 0.0
            for k in range(1, len(s) + 1):
                if s[:k] in pieces:
                    total_ += weight[pieces[s[:k]]] / whole * paths(s[k:], known)
                elif k == 1:
                    total_ += math.prod(weight[byte_ids[b]] / whole for b in s[:1].encode()) * paths(s[1:], known)
            known[s] = total_
        return known[s]

    every = lambda w: max(count[w] - d, 0) / total + d * len(count) / total * paths("▁" + w, {"": 1.0})
    out = {}
    for i, t, _ in rows:
        mixed = []
        for mine in by.values():
            c = Counter(w for ws in mine for w in ws)
            size = sum(c.values()) + len(mine)
            spread = d * len(c) / size * total / sum(count.values())
            lp = math.fsum(math.log10(max(c[w] - d, 0) / size + spread * every(w)) for w in words(t)) if c or not words(t) else -math.inf
            mixed.append(lp + math.log10(len(mine) / size * len(mine) / len(train)))
        top = max(mixed)
        out[i] = top + math.log10(math.fsum(10 ** (x - top) for x in mixed))
    return out


@pytest.mark.parametrize("bits", [lm.SLICE_BITS, 0])
def test_lm_scores_by_plain_recomputation(spark, monkeypatch, bits):
    """bits 0: each task's blocks are a slice of a word's places of their own."""
    monkeypatch.setattr(lm, "SLICE_BITS", bits)
    rows = texts(spark)
    want = plain_scores(rows)
    got = {r["doc_id"]: r["score"] for r in lm.lm_scores(spark.createDataFrame(rows, DOCS).repartition(6), block_bytes=300).collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[i], want[i], rel_tol=1e-5) for i in want)


def test_lm_deletes_what_it_wrote(spark):
    got = lm.lm_scores(spark.createDataFrame(texts(spark, 20), DOCS))
    root = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark) + "/tessella")
    left = {f.getPath().getName().rpartition("-")[0] for f in root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)}
    assert not left & {"lm-blocks", "lm-words", "lm-dictionaries"} and got.count() == 22


def test_jaccard_without_bitmap(spark, monkeypatch):
    """Where a bitmap would be full, the join with the candidates' ids alone finds their texts."""
    r = random.Random(3)
    base = [[r.choice("abcdefghij") + str(r.randrange(50)) for _ in range(60)] for _ in range(12)]
    rows = [(i, " ".join([*base[i % 12][: 60 - i % 3], *["z"] * (i % 2)])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, jaccard.jaccard_components(df).collect()))
    monkeypatch.setattr(jaccard, "BITMAP", (1, 0))
    assert sorted(map(tuple, jaccard.jaccard_components(df).collect())) == want and len({w[2] for w in want}) < 60


def test_token_files_are_even(spark):
    """Files end where sums over ranges of ids say: of even size, an id that fills several dealt over them, empty texts counted."""
    rows = [(i, "word " * (i * i % 91)) for i in range(-1000, 1000)] + [(7, f"again {k} " * 60) for k in range(300)] + [(None, "x"), (5000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    bounds = tokenbin._bounds(df, 20_000)
    total = sum(len((t or "").encode()) + 16 for i, t in rows if i is not None)
    assert abs(len(bounds) - total / 20_000) <= 2 and list(bounds) == sorted(bounds) and list(bounds).count(7) > 5
    sizes = [sum(len((t or "").encode()) + 16 for i, t in rows if i is not None and lo < i <= hi) for lo, hi in pairwise([-math.inf, *bounds.tolist()]) if not lo <= 7 <= hi]
    assert all(abs(s - 20_000) < 1_000 for s in sizes[1:])
    back = tokenbin.read_tokens(tokenbin.write_tokens(df, scratch(spark, "test-even"), file_bytes=20_000)).collect()
    assert len(back) == len(rows) and sum(r["n_tokens"] for r in back) == max(r["start"] + r["n_tokens"] for r in back)
    assert np.array_equal(tokenbin._bounds(spark.createDataFrame([(i, None) for i in range(5000)], "doc_id long, text string"), 20_000)[:3], [1250 - 1, 2500 - 1, 3750 - 1])


def test_letters_are_encoded_once_whatever_marks_follow():
    import public_tokenizers

    from tessella.llm.tokenbin import TOKENIZER, Encoder

    enc, merged = Encoder(public_tokenizers.path(TOKENIZER)), []
    plain = enc._merged
    enc._merged = lambda pieces: merged.extend(p for p in pieces if p) or plain(pieces)
    texts = ["So mot, mot. mot\nmot!\nmot?! 3.5, x-y; don't. ä, —, — ,a ..", "So mot; mot: mot, ä! mot.\n3.5. — ... mot'. (mot) mot-, é,é é"]
    for i, text in enumerate(texts):
        merged.clear()
        got = enc.encode([text, ""])
        assert got[0].tolist() == enc.t.encode(text, add_special_tokens=False).ids and not len(got[1])
        assert len(merged) == len(set(merged)) and (i == 0 or not {" mot", "So", " ä"} & set(merged))


def test_heads_of_postings_take_little_room_in_many_buckets(spark):
    """At 30 GB there are some 70 postings of a task to a bucket, and nearly each has a head of its own."""


    rng = np.random.default_rng(6)
    texts = [(i, " ".join(f"w{w}" for w in rng.integers(0, 5000, 300))) for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    rows = jaccard._postings(docs, jaccard.Schemes(), 5, 700).collect()
    n = sum(len(jaccard._plain(r["del_"], "u1")) for r in rows if r["del_"])
    heads = [k for k in rows[0].asDict() if k.startswith("h_")]
    room = sum(len(r[k] or b"") for r in rows for k in (*heads, *jaccard._POST))
    assert n > 20_000 and room < 24 * n  # 33 bytes a head and 10 a posting without squeezing
    for v in (np.arange(5, dtype="<u8") << 40, np.zeros(0, "<u4"), np.array([-1, 3], "<i8"), np.ones(900, "u1")):
        assert np.array_equal(jaccard._plain(jaccard._squeezed(v), v.dtype.str), v)
