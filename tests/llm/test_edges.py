"""Null, empty and repeated rows, empty tables and columns of clashing names, for every operator."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessella.llm import ann, chat, decontam, jaccard, lm, mixing, quality, tokenbin, urls, warc
from tessella.llm._common import scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = ["block", "words", "word", "kind", "held_out", "size", "n", "key", "h", "score", "shard", "dim", "v", "id", "path", "host", "rule", "taken", "target", "part", "set_id", "payload", "component_id", "n_shingles", "window", "places", "start"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def clashing(df):
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH if c not in df.columns])


def documents(spark, n=40):
    rows = [(i, " ".join(f"w{(i * 7 + j * j) % 23}" for j in range(i % 13)), "en" if i % 3 else None, "s" if i % 4 else None, i) for i in range(n)]
    rows += [(n, None, "de", "s", None), (n + 1, "", None, None, 0), (n + 2, " \t\n", "en", "s", 3), (n + 3, "Äb ÄB äb " * 3000, "de", "t", 9), (n + 3, "Äb ÄB äb " * 3000, "de", "t", 9), (n + 4, "Äb ÄB äb " * 3000, None, "u", 9)]
    return spark.createDataFrame(rows, DOCS)


def test_lm_base_score_and_counts(spark):
    docs = documents(spark)
    rows = [(r["doc_id"], [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(r["text"] or "")]) for r in docs.collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    counts = Counter(w for i, ws in rows if not held(i) for w in [*ws, None])
    total, floor = sum(counts.values()), sum(counts.values()) + 0.1 * (len(counts) + 1)
    want = sorted((i, held(i), len(ws) + 1, sum(counts[w] > 0 for w in [*ws, None]), total, sum(math.log10((counts[w] + 0.1) / floor) for w in [*ws, None])) for i, ws in rows)
    got = lm.lm_scores(clashing(docs)).collect()
    have = sorted((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got)
    assert [h[:5] for h in have] == [w[:5] for w in want] and all(math.isclose(h[5], w[5], rel_tol=1e-9) for h, w in zip(have, want, strict=True))
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_warc_round_trip(spark):
    rows = [(1, "http://a/", "<p>é</p>"), (2, None, None), (3, "http://b/", ""), (4, "http://a/", "<p>é</p>"), (5, "u", "x" * 100_000)]
    files = warc.write_archives(clashing(spark.createDataFrame(rows, "page_id long, url string, html string")), scratch(spark, "test-warc"))
    got = {warc.page_of(r["record_id"]): (r["record_type"], r["payload_digest"], r["payload_bytes"], warc.page_of(r["refers_to"])) for r in warc.read_archives(files).collect()}
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    first = {1: None, 2: None, 3: 2, 4: 1, 5: None}
    assert {int(k): (*v[:3], v[3] and int(v[3])) for k, v in got.items()} == {i: ("revisit" if first[i] else "response", digest(h), len((h or "").encode()), first[i]) for i, _, h in rows}


def run_all(spark, docs, pages, chats, vectors, labels, bench):
    return {
        "chat": chat.format_chats(chats).count(), "mix": mixing.mix(docs).count(), "jaccard": jaccard.jaccard_components(docs).count(), "near": jaccard.deduplicate(docs).count(),
        "nearest": ann.nearest(vectors, lambda i: i % 100 == 0).count(), "lm": lm.lm_scores(docs).count(), "tokens": tokenbin.read_tokens(tokenbin.write_tokens(docs, scratch(spark, "test-tokens"))).count(),
        "quality": quality.quality_scores(docs, labels).count(), "leaks": decontam.decontaminate(docs, bench).count(), "urls": urls.filter_urls(pages).count(), "warc": warc.read_archives(warc.write_archives(pages, scratch(spark, "test-warc"))).count(),
    }


@pytest.mark.parametrize("empty", [False, True])
def test_clashing_columns_and_empty_tables(spark, empty):
    tables = (documents(spark), spark.createDataFrame([(1, "http://a.b/c", "h"), (2, None, None)], "page_id long, url string, html string"),
              spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", None)], "conv_id long, turn long, role string, text string"),
              spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, None)], "vec_id long, embedding array<float>"),
              spark.createDataFrame([(1, 1), (2, 0), (None, None)], "doc_id long, quality int"), spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve")], "item_id long, text string"))
    got = run_all(spark, *[clashing(t.limit(0) if empty else t) for t in tables])
    if empty:
        assert set(got.values()) == {0}
    else:
        n = tables[0].count()
        assert got["jaccard"] == got["lm"] == got["tokens"] == got["quality"] == got["leaks"] == n
        assert (got["chat"], got["urls"], got["warc"], got["nearest"]) == (1, 2, 2, 1) and got["near"] == n - 1


def test_decontamination_of_two_texts_of_one_id_and_of_long_texts(spark):
    item = "the quick brown river carries seven old boats down to the quiet harbour before winter"
    words = item.split()
    half = [" ".join(words[:9]), " ".join(words[6:])]  # each by itself: neither half of one id makes a whole
    rows = [(1, "nothing"), (1, f"so {item} then"), (2, "filler words here " * 60_000 + item), (3, half[0]), (3, half[1] + " x"), (4, None), (None, item), (5, item.upper())]
    got = decontam.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(9, item)], "item_id long, text string"))
    found = {r["doc_id"]: r for r in got.collect()}
    n = len(words) - decontam.WINDOW + 1
    assert {1, 2, 5} <= set(found) and not {4, None} & set(found)
    assert all((found[i]["n_windows"], found[i]["item_windows"], found[i]["kind"]) == (n, n, "exact") for i in (1, 2, 5))
    assert 3 not in found or found[3]["n_windows"] < n


def test_urls_of_null_and_repeated_pages(spark):
    rows = [(None, "https://a.net/x", None), (1, "https://b.example.net/en/x", None), (1, "https://b.example.net/en/x", None), (2, None, None), (2, "https://Q.example.com/de/?x", None)]
    got = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r["page_id"] or 0, r["host"], r["path"], r["rule"], r["verdict"]) for r in got if r["rule"]) == [
        (0, "a.net", "/x", "net/", "block"), (1, "b.example.net", "/en/x", "example.net/en/", "allow"), (1, "b.example.net", "/en/x", "example.net/en/", "allow"), (2, "q.example.com", "/de/", "example.com/de/", "block")]
    assert [(r["host"], r["path"]) for r in got if not r["rule"]] == [("", "")]


def test_chats_of_null_turns_and_roles(spark):
    rows = [(1, None, "user", "first"), (1, 0, None, "b"), (1, 0, "assistant", None), (1, 1, "assistant", "c"), (None, 0, "user", "d"), (None, 0, "user", "d")]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted(r["conv_id"] or 0 for r in got.collect()) == [0, 1]


def test_quality_of_repeated_ids_with_other_texts(spark):
    texts = ["good solid prose about rivers and towns", "click here win win win now", "", None]
    rows = [(i % 20, texts[(i + i // 20) % 4], "en", "s", 0) for i in range(80)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(20)], "doc_id long, quality int")
    got = quality.quality_scores(spark.createDataFrame(rows, DOCS), labels).collect()
    assert len(got) == 80 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert len({(r["text"] or "", r["score"]) for r in got}) == len({r["text"] or "" for r in got})


def test_nearest_ties_by_the_index(spark):
    """Repeated vectors on the indexed path: ties go to the smaller id, and every copy may be found."""
    rows = [(i, [float(i % 40), float(i % 40 % 7), 1.0]) for i in range(1200)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 100 == 0).collect()
    for q in range(0, 1200, 100):
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert own == [(k + 1, i, 0.0) for k, i in enumerate([i for i in range(q % 40, 1200, 40) if i != q][:10])]
