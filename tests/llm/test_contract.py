"""The registered queries on the smallest tables: against their SQL, or against the statement of their contract in plain Python."""

import glob
import math
import os
import re
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from tessella.llm import quality, registry

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def read(table, *columns):
    return pq.read_table(f"{SF}/{table}.parquet", columns=list(columns)).to_pylist()


def plain(x):
    return round(x, 6) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    rel = con.sql(registry.oracle_sql()[name])
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    at = [rel.columns.index(c) for c in columns]
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def test_op4_equals_brute_force(spark):
    rows = read("documents", "doc_id", "text")
    sets = {}
    for r in rows:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(r["text"] or "")]
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    label = {d: d for d in sets}
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if label[a] != label[b] and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {d: low if x == high else x for d, x in label.items()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in registry.queries()["op4_jaccard"](spark, SF).collect()}
    assert got == {d: (len(s), label[d]) for d, s in sets.items()}


def test_op5_recall_and_scores(spark):
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in read("embeddings", "vec_id", "embedding") if r["embedding"] is not None]
    rows = [(i, v) for i, v in rows if len(v) and np.isfinite(v).all() and v.any()]
    got = registry.queries()["op5_nearest"](spark, SF).collect()
    hit = total = 0
    for q, v in rows:
        if q % 100 == 0:
            best = sorted((math.dist(v, x), i) for i, x in rows if i != q)[:10]
            own = {r["vec_id"]: r["score"] for r in got if r["query_id"] == q}
            assert len(own) == len(best)
            hit += len(own.keys() & {i for _, i in best})
            total += len(best)
    assert hit >= 0.9 * total


def test_op7_equals_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t, at, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, set()
    for r in sorted(read("documents", "doc_id", "text"), key=lambda r: r["doc_id"]):
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want.add((r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert {tuple(r) for r in registry.queries()["op7_token_output"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()} == want


def test_op8_ranks_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    quality_of = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{folder}/labels.parquet").to_pylist()}
    got = registry.queries()["op8_quality"](spark, folder).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [(r["score"], quality_of[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and quality_of.get(r["doc_id"]) is not None]
    good, bad = [s for s, y, _ in held if y], [s for s, y, _ in held if not y]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc >= 0.95 and sum(p == y for _, y, p in held) / len(held) >= 0.9


def test_class_prior_is_near_the_truth():
    rng = np.random.default_rng(2)
    for truth in (0.2, 0.5, 0.8):
        positive = rng.normal(1.5, 1, (4000, 3))
        n = int(4000 * truth)
        unlabelled = np.concatenate([rng.normal(1.5, 1, (n, 3)), rng.normal(-1.5, 1, (4000 - n, 3))])[rng.permutation(4000)]
        assert abs(quality.class_prior(positive, unlabelled) - truth) < 0.1


def test_op10_rules(spark):
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    pages = {r["page_id"]: r["url"] or "" for r in read("pages", "page_id", "url")}
    got = registry.queries()["op10_url_filter"](spark, SF).collect()
    assert {r["page_id"] for r in got} == set(pages) and {r["verdict"] for r in got} <= {"allow", "block"}
    for r in got:
        rest = pages[r["page_id"]].split("://", 1)[1] if "://" in pages[r["page_id"]] else ""
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        host = host.translate({c: c + 32 for c in range(65, 91)})
        fits = [k for k in rules if (host == k.split("/")[0] or host.endswith("." + k.split("/")[0])) and path.startswith("/" + k.split("/", 1)[1])]
        rule = max(fits, key=len, default=None)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and (rule is None or r["verdict"] == rules[rule])


def test_lattice_sums_all_segmentations():
    from tessella.llm import lm

    pieces = {"▁": 0, "a": 1, "b": 2, "ab": 3, "▁a": 4, "ba": 5, "aba": 6}
    byte_ids = np.arange(7, 263)
    w = np.log(np.random.default_rng(4).random(263))

    def paths(s):
        if not s:
            return 1.0
        total = 0.0
        for k in range(1, len(s) + 1):
            if s[:k] in pieces:
                total += math.exp(w[pieces[s[:k]]]) * paths(s[k:])
            elif k == 1:
                total += math.exp(sum(w[byte_ids[b]] for b in s[:1].encode())) * paths(s[1:])
        return total

    lattice = lm.Lattice(pieces, byte_ids, w)
    for word in ("abab", "é", "aéb", "", "babab"):
        assert math.isclose(lattice.log_p(word.encode()), math.log(paths("▁" + word)), rel_tol=1e-9)


def test_pipeline_stages(spark):
    """Each stage against the query of its operator on the same rows, with rows that are null, empty, repeated and long."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from pyspark.sql import functions as F

    from tessella.llm import mixing

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, "long words " * 30_000, "de", None, 3)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(more.select(*[F.col(c).cast(docs.schema[c].dataType) for c in docs.columns]))
    clash = docs.select("*", *[F.lit("x").alias(c) for c in ("score", "predicted", "component_id", "taken", "target", "size", "id", "words", "_gone", "_leaked", "row", "part")])
    for (name, stage), own in zip(corpus_pipeline.STAGES[:-1], (quality_of, near_of, leaks_of, mixing.mix), strict=True):
        got = stage(spark, clash, SF)
        assert got.columns == clash.columns, name
        assert sorted(map(repr, got.select("doc_id").collect())) == sorted(map(repr, own(spark, docs).select("doc_id").collect() if own is not mixing.mix else own(docs).select("doc_id").collect())), name
        assert stage(spark, clash.limit(0), SF).count() == 0, name
    tokens = corpus_pipeline.STAGES[-1][1](spark, clash, SF).collect()
    assert len(tokens) == docs.count() and sum(r["n_tokens"] for r in tokens) == max(r["start"] + r["n_tokens"] for r in tokens)
    assert corpus_pipeline.STAGES[-1][1](spark, clash.limit(0), SF).count() == 0


def quality_of(spark, docs):
    return quality.quality_scores(docs.select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")).where("score >= 0.3")


def near_of(spark, docs):
    from tessella.llm import jaccard

    found = jaccard.jaccard_components(docs.select("doc_id", "text"))
    return docs.join(found.where("doc_id <> component_id").select("doc_id").distinct(), "doc_id", "left_anti")


def leaks_of(spark, docs):
    from tessella.llm import decontam

    found = decontam.find_leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti")


def test_pipeline_run(spark):
    """run() whole: the stages' operators one after the other, then the ids of what is left by the library itself."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    import struct
    import zlib

    import public_tokenizers
    import tokenizers

    from tessella.llm import mixing
    from tessella.llm._common import saved

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for step in (quality_of, near_of, leaks_of):
        docs = saved(docs.join(step(spark, docs).select("doc_id"), "doc_id", "left_semi").select(*docs.columns), "test-pipeline")
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, start = [], 0
    for r in sorted(mixing.mix(docs).select("doc_id", "text").collect(), key=lambda r: r["doc_id"]):
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want.append((r["doc_id"], len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
    got = sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: (r[0], r[1]))
    assert want and sorted((i, n, c) for i, _, n, c in got) == sorted(want)
    for _, at, n, _ in got:
        assert at == start
        start += n
