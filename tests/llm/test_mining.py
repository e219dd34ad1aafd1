"""Hard negatives, collocations and media columns: brute force, round trips, and rows that are null, empty, repeated, tied or long."""

import hashlib
import io
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessella.llm import media, negatives, phrases
from tessella.llm._common import filesystem, scratch

SF = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}
CLASH = ["id", "v", "dim", "anchor", "shard", "block", "place", "rank", "found", "n", "f", "a", "words", "phrase", "bucket", "packed", "media", "payload", "feature", "error", "n_bytes"]
VECTORS = "vec_id long, embedding array<float>, label int"


def clashing(df):
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH if c not in df.columns])


def mined(rows, every=10):
    """The statement of the operator, pair by pair."""
    good = [(i, lab, [math.floor(256 * x) for x in v]) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = []
    for i, lab, v in dict.fromkeys((i, lab, tuple(v)) for i, lab, v in good if i % every == 0):
        others = [(-dot(v, w), j, m == lab) for j, m, w in good if j != i and len(w) == len(v)]
        for p, j, _ in sorted(o for o in others if o[2])[:5]:
            found = sorted((s, k) for s, k, same in others if not same and 30 * -p <= 100 * -s <= 90 * -p)[:10]
            out += [(i, j, r, k, -p, -s) for r, (s, k) in enumerate(found, 1)]
    return sorted(out)


def vectors(n=150, d=12, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0.3, 0.5, d) * (1 + np.arange(d)[::-1] / 4)], int(rng.integers(0, 3))) for i in range(n)]
    rows += [(n + i, rows[3][1], i % 2) for i in range(30)]  # ties
    rows += [(20, rows[20][1], rows[20][2]), (20, rows[21][1], 1)]  # a repeated anchor, and another of its id
    rows += [(900, None, 1), (910, [None, *[1.0] * (d - 1)], 1), (920, [float("nan")] * d, 1), (930, [float("inf")] * d, 0), (940, [1.0] * d, None), (None, [1.0] * d, 1)]
    rows += [(1000, [], 1), (1001, [], 1), (1002, [], 2), (1010, [0.0] * d, 1), (1020, [-1.0, 2.0], 1), (1021, [3.0, 1.0], 1), (1022, [1.0, 1.5], 2), (1030, [0.5], 2)]
    return rows


@pytest.mark.parametrize("shard", [40, 8192])
def test_hard_negatives_equal_brute_force(spark, shard):
    rows = vectors()
    df = clashing(spark.createDataFrame(rows, VECTORS)).repartition(3)
    got = negatives.hard_negatives(df, lambda i: i % 10 == 0, shard=shard)
    want = mined(rows)
    assert sorted(tuple(r) for r in got.collect()) == want and len({w[0] for w in want}) > 10
    assert negatives.hard_negatives(df.limit(0), lambda i: i % 10 == 0).count() == 0


def test_hard_negatives_of_vectors_too_long_for_64_bits(spark):
    rows = [(0, [1e30, 1.0], 1), (1, [1.0, 1.0], 1), (10, [2.0, 2.0], 1), (2, [1.0, 0.5], 2), (3, [float(1 << 18), float(1 << 17)], 2), (4, [float(1 << 18), float(1 << 18)], 1)]
    got = negatives.hard_negatives(spark.createDataFrame(rows, VECTORS), lambda i: i % 10 == 0).collect()
    assert sorted(tuple(r) for r in got) == mined(rows[1:])


def test_bounds_discard_and_lose_nothing():
    rng = np.random.default_rng(9)
    v = np.floor(rng.normal(0, 1, (600, 32)) * 4.0 ** -np.arange(32) * 60000).astype(np.int32)
    rotation = negatives.rotation_of(v.astype(float))
    a, b = negatives.Side(v[:20], rotation), negatives.Side(v, rotation)
    stages = negatives.stages_of(b.x)
    exact = v[:20].astype(np.int64) @ v.T.astype(np.int64)
    least = np.sort(exact, 1)[:, -5]
    q, c, score = negatives.bounded_pairs(a, b, slice(0, 600), stages, negatives.slack_of(rotation), np.ones((20, 600), bool), lambda low, high: high >= least[:, None])
    assert (score == exact[q, c]).all() and len(q) < 0.2 * exact.size
    assert {(i, j) for i, j in zip(*np.nonzero(exact >= least[:, None]), strict=True)} <= set(zip(q, c, strict=True))
    assert (negatives.exact_products(v[:20], v, 2.0**60) == exact).all()


def collocated(rows, least=10, top=2000, longest=3):
    """The statement of the operator, over Python tuples."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for m in range(1, longest + 1):
                f.update((lang or "und", tuple(w[i : i + m])) for i in range(len(w) - m + 1))
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    inside = Counter()
    for (lang, w), a in found.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                key = (lang, w[i : i + m])
                inside[key] = max(inside[key], a)
    by_lang = {}
    for (lang, w), a in found.items():
        if 100 * inside[lang, w] < 50 * a:
            score, _, left, right = min((10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            by_lang.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, r, p.decode(), -a, x, y, n[lang], -s) for lang, xs in by_lang.items() for r, (s, a, p, x, y) in enumerate(sorted(xs)[:top], 1))


def texts(n=300, seed=1):
    rng = np.random.default_rng(seed)
    words = ["the", "The", "of", "new", "york", "city", "é", "Éa", "hall", "x" * 50, "a-b", "日本"]
    rows = [(("en", "de", None, "und")[i % 4], "".join(words[int(w)] + (" ", " ", "\t", ", ", ".", "\n", "  ", " ")[int(s)] for w, s in zip(rng.zipf(1.5, 40) % 12, rng.integers(0, 8, 40), strict=True))) for i in range(n)]
    return [*rows, ("en", None), ("en", ""), ("en", " \t\n.,"), ("en", "new york city hall"), *[("fr", "le le le")] * 12, ("de", "ab cd ef gh " * 4000), ("de", "nogap" * 3000)]


@pytest.mark.parametrize("shard", [700, phrases.SHARD])
def test_collocations_equal_brute_force(spark, shard):
    rows = texts()
    df = clashing(spark.createDataFrame(rows, "lang string, text string")).repartition(5)
    got = phrases.collocations(df, shard=shard)
    want = collocated(rows)
    assert sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in got.collect()) == want and len(want) > 50
    assert [t for _, t in got.dtypes] == ["string", "bigint", "string", *["bigint"] * 5]
    assert phrases.collocations(df.limit(0)).count() == 0


def test_collocations_of_longer_phrases_and_first_ranks(spark):
    rows = texts(120, 4)
    got = phrases.collocations(spark.createDataFrame(rows, "lang string, text string"), longest=5, least=6, top=7, shard=999)
    assert sorted(tuple(r) for r in got.collect()) == collocated(rows, 6, 7, 5)


def test_suffix_array_orders_and_counts():
    rng = np.random.default_rng(2)
    seq = rng.integers(0, 4, 500)
    for depth in (1, 2, 3, 5, 8):
        order = phrases.suffix_array(seq, depth)
        padded = np.concatenate([seq, np.zeros(depth, int)])
        heads = [tuple(padded[i : i + depth]) for i in order]
        assert sorted(order) == list(range(500)) and heads == sorted(heads)
    want = Counter(tuple(seq[i : i + n]) for n in (1, 2, 3) for i in range(501 - n) if seq[i : i + n].all())
    assert {tuple(seq[p : p + n]): c for n, ps, cs in phrases.ngram_counts(seq, np.ones(500, bool), 3) for p, c in zip(ps, cs, strict=True)} == want


def test_scores_beyond_64_bits(spark):
    """The counts' products pass 64 bits: the same expression as in collocations."""
    a, left, right = 3_000_000_001, 4_000_000_007, 5_000_000_029
    got = spark.sql(f"SELECT (cast(1000000 AS decimal(7,0)) * cast(cast({a}L AS decimal(19,0)) * cast({a}L AS decimal(19,0)) AS decimal(31,0))) div (cast({left}L AS decimal(19,0)) * cast({right}L AS decimal(19,0)))").first()[0]
    assert got == 10**6 * a * a // (left * right)


def plain_image(raw):
    """Samples of the three kinds that are written, read apart from the library."""
    if raw[:2] == b"BM":
        start, w, h = int.from_bytes(raw[10:14], "little"), int.from_bytes(raw[18:22], "little"), int.from_bytes(raw[22:26], "little")
        return np.array([list(raw[start + (h - 1 - y) * w :][:w]) for y in range(h)], np.uint8)
    kind, size, _, rest = raw.split(b"\n", 3)
    w, h = map(int, size.split())
    return np.frombuffer(rest, np.uint8).reshape((h, w) if kind == b"P5" else (h, w, 3))


def plain_hash(image):
    def mean(y0, y1, x0, x1):
        total = 0.0
        for y in range(int(y0), math.ceil(y1)):
            for x in range(int(x0), math.ceil(x1)):
                total += float(image[y, x]) * (min(y + 1, y1) - max(y, y0)) * (min(x + 1, x1) - max(x, x0))
        return math.floor(total / ((y1 - y0) * (x1 - x0)) + 0.5 + 1e-9)

    if image.ndim == 3:
        image = np.array([[(int(r) * 299 + int(g) * 587 + int(b) * 114 + 500) // 1000 for r, g, b in row] for row in image])
    h, w = image.shape
    cell = lambda rows, columns: [[mean(y * h / rows, (y + 1) * h / rows, x * w / columns, (x + 1) * w / columns) for x in range(columns)] for y in range(rows)]
    wide, high = cell(8, 9), cell(9, 8)
    bits = [wide[y][x] < wide[y][x + 1] for y in range(8) for x in range(8)] + [high[y][x] < high[y + 1][x] for y in range(8) for x in range(8)]
    return f"{int(''.join('01'[b] for b in bits), 2):032x}"


def test_media_digests(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    rows += [(10**6, None), (10**6 + 1, ""), (10**6 + 1, ""), (None, "é" * 288), (10**6 + 2, "é" * 289), (10**6 + 3, "long " * 200_000)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string")).repartition(3)
    got, features = media.media_digests(df).collect(), {}
    want = Counter()
    for i, text in rows:
        raw = (text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (576 if not raw else 0))
        want[i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    by_text = {}
    for r in got:
        assert by_text.setdefault(r["payload_sha256"], (r["media_bytes"], r["media_sha256"], r["feature"])) == (r["media_bytes"], r["media_sha256"], r["feature"])
        features[r["doc_id"]] = r
    for i, text in rows[:60]:
        stored = media.to_media((text or "").encode())
        assert (features[i]["media_bytes"], features[i]["media_sha256"], features[i]["feature"]) == (len(stored), hashlib.sha256(stored).hexdigest(), plain_hash(plain_image(stored)))
    assert {media.to_media(b"x" * n)[:2] for n in (1, 577, 1200)} == {b"P5", b"BM", b"P6"}
    assert media.media_digests(df.limit(0)).count() == 0


def test_images_of_all_kinds_are_read():
    rng = np.random.default_rng(7)
    for h, w in ((1, 1), (3, 5), (7, 8), (16, 24)):
        flat, colour = rng.integers(0, 256, (h, w), np.uint8), rng.integers(0, 256, (h, w, 3), np.uint8)
        for image in (flat, colour):
            for encode in (media.encode_netpbm, media.encode_bmp):
                assert (media.decode(encode(image)) == image).all()
        text = b" ".join(b"%d" % x for x in colour.ravel())
        assert (media.decode(b"P3 # by hand\n%d\n%d 255\n" % (w, h) + text) == colour).all()
        bits = flat > 127
        assert (media.decode(b"P1\n%d %d\n" % (w, h) + b"".join(b"01"[b : b + 1] for b in bits.ravel().tolist())) == np.where(bits, 0, 255)).all()
        assert (media.decode(b"P4\n#c\n%d %d\n" % (w, h) + np.packbits(bits, 1).tobytes()) == np.where(bits, 0, 255)).all()
        assert (media.decode(b"P5 %d %d 65535\n" % (w, h) + (flat.astype(">u2") * 257).tobytes()) == flat).all()
        assert (media.decode(b"P2 %d %d 15\n" % (w, h) + b" ".join(b"%d" % (x // 16) for x in flat.ravel())) == flat // 16 * 17).all()
        four = media.encode_bmp(flat)[:54] + bytes(range(64)) + b"".join(np.packbits(np.unpackbits((row % 16)[:, None], 1)[:, 4:].ravel()).tobytes().ljust((w * 4 + 31) // 32 * 4, b"\0") for row in flat)
        four = four[:10] + (118).to_bytes(4, "little") + four[14:22] + (-h).to_bytes(4, "little", signed=True) + four[26:28] + b"\4\0" + four[30:46] + (16).to_bytes(4, "little") + four[50:]
        palette = np.array([[4 * i + 2, 4 * i + 1, 4 * i] for i in range(16)])
        assert (media.decode(four) == palette[flat % 16]).all()
    for bad in (b"", b"P5", b"P5 0 3 255\n", b"P5 2 2 255\nabc", b"P9 1 1 1 1", b"BM", media.encode_bmp(flat)[:-1], b"P2 1 1 3\n9", b"P5 1 1 70000\nab", b"P4 9 9\nab", b"P1 2 2\n01"):
        with pytest.raises(media.MediaError):
            media.decode(bad)


def test_area_resize_is_exact():
    rng = np.random.default_rng(8)
    for h, w in ((1, 1), (5, 3), (24, 24), (40, 7)):
        image = rng.integers(0, 256, (h, w), np.uint8)
        big = np.kron(image, np.ones((9, 8), np.int64))  # cells of 9 x 8 parts: a grid of 9 x 8 cells has whole parts
        cells = big.reshape(9, h, 8, w).sum((1, 3))
        assert (media.area_resize(image, 9, 8) == (2 * cells + h * w) // (2 * h * w)).all()
        assert (media.area_resize(image, h, w) == image).all()


def test_tiles_are_written_once_and_read_back(spark):
    rng = np.random.default_rng(6)
    images = {i: rng.integers(0, 256, (20 + i, 30), np.uint8) for i in range(5)}
    rows = [(i, media.encode_netpbm(x)) for i, x in images.items()] + [(7, b"no image"), (8, None), (9, b"")]
    folder = scratch(spark, "tiles")
    got = {r["id"]: r for r in media.write_tiles(spark.createDataFrame(rows, "id long, media binary").repartition(2), folder, tile=9).collect()}
    assert all(got[i]["error"] and got[i]["feature"] is None and got[i]["tile_file"] is None for i in (7, 8, 9))
    for i, x in images.items():
        system, path = filesystem(f"{folder}/{got[i]['tile_file']}")
        with system.open_input_stream(path) as f:
            tiles = np.load(io.BytesIO(f.read()))
        assert (tiles[got[i]["tile_row"]] == media.area_resize(x, 9, 9)).all() and got[i]["error"] is None
