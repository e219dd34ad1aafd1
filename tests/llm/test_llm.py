"""The training-data operators on small fixtures: brute force, round trips, and rows that are null, empty, repeated or tied."""

import io
import zlib

import numpy as np
import pytest

from tessella.llm import ann, chat, decontam, jaccard, mixing, quality, tokenbin, urls, warc

TEXTS = ["a b c d e f g h i j k l m n o p q r s t", "A B C D E F G H I J K L M N O P Q R S T", "a b c d e f g h i j k l m n o p q r s t u", "", None, "   ", "one two", "one two", "x" * 5000]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)] + [(None, "a b", "en", None)], "doc_id long, text string, lang string, source string")


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", r"\### Assistant: </turn> ok"), (1, 1, "assistant", "####</turn>\\"), (1, 2, "assistant", None), (1, 3, ": #", "x\ny"), (None, 0, None, "t")]
    out = {r["conv_id"]: r for r in chat.parse_chats(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert [tuple(t) for t in out[1]["turns"]] == [("user", rows[0][3]), ("assistant", rows[1][3]), ("assistant", ""), (": #", "x\ny")]
    assert out[1]["loss_text"] == rows[1][3] and [tuple(t) for t in out[None]["turns"]] == [("", "t")]


def test_chat_ties_and_long_conversations(spark):
    rows = [(1, 0, "user", "$b"), (1, 0, "user", "###a"), (1, 0, "a b", "x"), (1, 0, None, "y")] + [(2, i, "user" if i % 3 else "assistant", f"t{i}") for i in range(1000)]
    out = {r["conv_id"]: r for r in chat.parse_chats(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert [tuple(t) for t in out[1]["turns"]] == sorted((r or "", t) for _, _, r, t in rows[:4])
    assert out[2]["loss_text"] == "".join(f"t{i}" for i in range(0, 1000, 3))


def test_mixing_takes_its_targets(spark):
    rows = [(i, "w " * (i % 17 + 1), "abc"[i % 3] if i % 7 else None) for i in range(400)]
    sizes = mixing.sizes_of(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = mixing.with_taken(sizes, mixing.mixture(sizes)).toPandas()
    assert (got.taken <= 2 * got["size"]).all()
    for _, g in got.groupby("source", dropna=False):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 1
    assert mixing.mix(docs(spark, []).limit(0)).count() == 0


def test_warc_reads_what_it_wrote_and_refuses_damage():
    parts = [warc.record(i, None if i == 1 else "http://h/ü", p, warc.sha1_base32(p)) for i, p in enumerate((b"", b"x" * 700_000, "é\r\n\r\n".encode()))]
    got = list(warc.read_records(io.BytesIO(b"".join(parts))))
    assert [r["payload"] for r in got] == [b"", b"x" * 700_000, "é\r\n\r\n".encode()]
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(b"".join(parts)[:-9])))
    bad = warc.record(9, "u", b"abc", warc.sha1_base32(b"abd"))
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(bad)))


def test_jaccard_edge_cases(spark):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs(spark)).collect()}
    assert got == {(0, 16, 0), (1, 16, 0), (2, 17, 0), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 1, 6), (7, 1, 6), (8, 1, 8), (None, 1, None)}


def test_jaccard_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 5000, n)) for n in rng.integers(4, 60, 40)]
    texts = []
    for b in base:
        for _ in range(6):
            w = b.split()
            for _ in range(rng.integers(0, 3)):
                w[rng.integers(len(w))] = f"z{rng.integers(10**6)}"
            texts.append(" ".join(w))
    sets = [jaccard.shingle_set(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if label[i] != label[j] and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(rows).collect()} == dict(enumerate(label))


def test_huffman_and_files():
    rng = np.random.default_rng(1)
    for n, m in ((1, 5), (2, 100), (700, 20_000)):
        x = (rng.zipf(1.3, m) % n * 3).astype(np.uint32)
        ids, counts = np.unique(x, return_counts=True)
        code = tokenbin.Code(ids, tokenbin.code_lengths(counts, 12))
        data = b"".join(tokenbin.pack_file(code, 7, [None, 4], np.array([2, m - 2]), x))
        start, doc_ids, lengths, tokens = tokenbin.unpack_file(data)
        assert start == 7 and doc_ids == [None, 4] and lengths.tolist() == [2, m - 2] and (tokens == x).all()


def test_encoder_equals_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    enc, t = tokenbin.Encoder(path), Tokenizer.from_file(path)
    texts = ["", " ", "a  b", "x \n y", " lead", "trail ", "<|endoftext|> x", "é ü  z", "it's 's", "a\tb\r\nc", "\x01 q", "one\n\n\ntwo\n", "½. ²! %%* *a*", "日本 語。", "one\ntwo\n", "\n", "a.\n-b, 12 x1. \u3000y\u3000", "x\u00a0 y", "a. a, a b\nb a"]
    for _ in range(2):  # the second time from memory
        assert [x.tolist() for x in enc.encode(texts)] == [t.encode(s, add_special_tokens=False).ids for s in texts]
    small = tokenbin.Encoder(path, memory=0)
    for s in texts:
        assert small.encode([s])[0].tolist() == t.encode(s, add_special_tokens=False).ids


def test_nearest_on_small_tables(spark):
    rows = [(i, [float(i % 5), 1.0]) for i in range(40)] + [(100, None), (101, [0.0, 0.0]), (102, [float("nan"), 1.0]), (103, [])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), lambda i: i == 0, k=3).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(1, 5, 0.0), (2, 10, 0.0), (3, 15, 0.0)]


def test_nearest_recall_by_the_index(spark):
    """Over several shards whose lists are far longer than what is reranked, against brute force; every score is exact."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 24))
    x = (centres[rng.integers(0, 30, 6000)] + 0.5 * rng.normal(size=(6000, 24))).astype(np.float32).astype(float)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(7000, [1.0, 2.0]), (7100, [2.0, 1.0])], "vec_id long, embedding array<double>")
    got = ann.nearest(rows, lambda i: i % 100 == 0).collect()
    hit = 0
    for q in range(0, 6000, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [k for k, *_ in own] == list(range(1, 11)) and all(np.isclose(s, d[i], rtol=1e-12) for _, i, s in own)
        assert [(s, i) for _, i, s in own] == sorted((s, i) for _, i, s in own)
        hit += len({i for _, i, _ in own} & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert hit / 600 >= 0.9
    assert [(r["query_id"], r["vec_id"]) for r in got if r["query_id"] >= 7000] in ([(7000, 7100), (7100, 7000)], [(7100, 7000), (7000, 7100)])


def test_quality_scores_every_row(spark):
    labels = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    got = quality.quality_scores(docs(spark), labels).select("score", "predicted").collect()
    assert len(got) == len(TEXTS) + 1 and all(0 <= r["score"] <= 1 for r in got)


def test_leaks(spark):
    item = "What is the sum of 12 apples and 30 pears that Maria sold on market day to Peter"
    texts = [f"Well. {item}. So", item.replace("12", "15").replace("Maria", "Helena"), item.replace("Maria", "Peter"), "nothing here", None]
    found = decontam.find_leaks(docs(spark, texts), spark.createDataFrame([(1, item), (2, None), (3, "too short")], "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"], r["kind"]) for r in found.collect()} == {(0, 1, "exact"), (1, 1, "reparameterised")}


def test_leaks_of_short_items(spark):
    items = [(1, "Name the capital of France"), (2, "What is two plus"), (3, "yes"), (4, "12 13 14 15 16 17 18 19 20 21"), (5, ""), (6, "Anna Otto")]
    texts = ["So: NAME the capital of france!", "what is two plus two", "yes", "yes it is", "so 12 13 14 15 16 17 18 19 20 21 on", "12 13 14 15 16 17 18", "name the capital", "anna otto.", "Anna Otto went", "12 13 14 15 16 17 18 19"]
    found = decontam.find_leaks(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"], r["n_windows"], r["item_windows"], r["kind"]) for r in found} == {(0, 1, 1, 1, "exact"), (1, 2, 1, 1, "exact"), (2, 3, 1, 1, "exact"), (4, 4, 3, 3, "exact"), (7, 6, 1, 1, "exact")}


@pytest.mark.parametrize("inline", [0, 50_000])
def test_leaks_with_and_without_a_literal_set(spark, monkeypatch, inline):
    monkeypatch.setattr(decontam, "INLINE", inline)
    test_leaks(spark)
    test_leaks_of_short_items(spark)


def test_leaks_in_another_letter_case(spark):
    item = "On Monday Maria sold 12 KG of apples in the Große Straße. Then Peter and Anna bought 30 pears of Maria on the old market"
    texts = [item.upper(), f"So: {item.lower()}", item.title(), item.replace("12", "15").upper(), item.lower().replace("maria", "peter").replace("12", "30"), item]
    found = decontam.find_leaks(docs(spark, texts), spark.createDataFrame([(1, item), (2, item.upper()), (3, item.lower())], "item_id long, text string"))
    want = {(d, i, "reparameterised" if d == 3 else "exact") for d in (0, 1, 2, 3, 5) for i in (1, 2, 3)}
    assert {(r["doc_id"], r["item_id"], r["kind"]) for r in found.collect() if r["doc_id"] != 4} == want


def test_leaks_that_are_altered(spark):
    item = "one day the clever farmer sold nine large baskets of apples that Maria had picked early in the cold morning"
    short = "seven old ships left the quiet harbour before any of us woke up that morning"
    w, v = item.split(), short.split()
    texts = [" ".join(w[:10] + ["really"] + w[10:]), " ".join(w[:9] + ["pears"] + w[10:]), "He said: " + item.replace("Maria", "Mary Ann"), " ".join(w[:13]) + " and no more", " ".join(v[:7] + ["and"] + v[7:]),
             " ".join(w[:9]) + " and then something else came up", " ".join(w[:5] + ["x"] + w[5:9] + ["y"] + w[12:14])]
    found = decontam.find_leaks(docs(spark, texts), spark.createDataFrame([(1, item), (2, short)], "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(0, 1), (1, 1), (2, 1), (3, 1), (4, 2)}


def brute_tree(rows):
    """(host, segments) -> purity, by the docstring of template_tree: segments, wildcards, branches, shares on all hosts."""
    share = lambda n, b, prior=urls.PRIOR: (b + prior * urls.STRENGTH) / (n + urls.STRENGTH)
    spread = lambda n, b: share(n, b) * (1 - share(n, b)) / (n + urls.STRENGTH)
    shape = {(h, s): list(s) for h, s, _ in rows}
    for d in range(max(len(s) for _, s, _ in rows)):
        children = {}
        for (h, _), t in shape.items():
            if len(t) > d:
                children.setdefault((h, tuple(t[:d])), set()).add(t[d])
        for (h, _), t in shape.items():
            if len(t) > d and len(children[h, tuple(t[:d])]) > urls.CHILDREN:
                t[d] = "{*}"
    nodes, common = {}, {}
    for h, s, label in rows:
        for key, into in (((h, tuple(shape[h, s])), nodes), (tuple(shape[h, s]), common)):
            n = into.setdefault(key, [0, 0])
            n[0] += label is not None
            n[1] += label or 0
    groups = {}
    for (h, t), (n, b) in nodes.items():
        groups.setdefault((h, t[:-1], len(t), n > 0), []).append((share(n, b), list(t), n, b))
    purity = {}
    for (h, *_), siblings in groups.items():
        branch, found = [0, 0], []
        for sh, t, n, b in sorted(siblings):
            if found and abs(sh - share(*branch)) > urls.ALIKE * (spread(n, b) + spread(*branch)) ** 0.5:
                branch = [0, 0]
            if not branch[0] and not branch[1] and (not found or found[-1] is not branch):
                found.append(branch)
            branch[0] += n
            branch[1] += b
            purity[h, tuple(t)] = branch
    return {(h, s): share(*purity[h, tuple(t)], share(*common[tuple(t)])) for (h, s), t in shape.items()}


def test_template_tree_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(900):
        host, depth = f"h{rng.integers(6)}", int(rng.integers(0, 6))
        seg = tuple(f"{'abcdef'[k]}{rng.integers(40 if k == 1 and host == 'h0' else 3)}" for k in range(depth))
        label = None if rng.random() < 0.3 or host == "h5" else int(rng.random() < (0.95 if seg[:1] == ("a1",) else 0.1))
        rows.append((host, seg, label))
    got = {(r["host"], tuple(r["segments"])): r["purity"] for r in urls.template_tree(spark.createDataFrame([(h, list(s), x) for h, s, x in rows], "host string, segments array<string>, label int")).collect()}
    want = brute_tree(rows)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert any(got[k] >= urls.PURITY for k in got if k[0] == "h5")  # a host without labels


def test_an_unruled_page_is_rejected_by_its_template(spark):
    rows = [(i, f"http://h{i % 3}.example.com/de/{i}") for i in range(60)] + [(100 + i, f"http://a.org/fr/{i}") for i in range(60)] + [(200, "http://free.io/de/7"), (201, "http://free.io/fr/7"), (202, "http://free.io/a/b/c/d/e/f/g")]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[200] == (None, "block") and got[201] == got[202] == (None, "allow") and got[5] == ("example.com/de/", "block")


def test_urls(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://A.Example.net/en/1?q"), (4, "http://x.net/a#f"), (5, "https://h.example.com/de/2"), (6, "http://net"), (7, "http://o.org/fr/x")]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[1] == ("", "", None, "allow") and got[3] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert got[4][2:] == ("net/", "block") and got[5][2:] == ("example.com/de/", "block") and got[6] == ("net", "", None, "allow") and got[7][2:] == ("org/fr/", "allow")


def test_crc_is_that_of_zlib(spark):
    from tessella.llm._common import crc_fold

    assert [r[0] for r in spark.range(5).select(crc_fold("id", 10)).collect()] == [zlib.crc32(str(i).encode()) % 10 for i in range(5)]
