"""Quality classifier by positive-unlabelled learning: trusted positives, unlabelled web text, an estimated class prior."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._common import crc_fold

FOLDS, THRESHOLD = 5, 0.3
#: Rows of each kind that the classifier is fitted on, at most: those of the smallest hash of their id.
SAMPLE = 20_000
#: Quantile bins of each feature.
BINS = 16

FEATURES = (
    "log_bytes", "letters", "upper", "digits", "space", "newlines", "dots_per_word", "marks_per_word", "rare_marks_per_word", "bars_per_word",
    "top_byte", "byte_entropy", "bytes_per_word", "distinct_words", "repeated_neighbours", "top_word", "distinct_lines", "long_words")

_LETTER = np.array([chr(b).isalpha() and b < 128 or b >= 128 for b in range(256)])
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_SPACE = np.array([b in b" \t\n\r\x0b\x0c" for b in range(256)])
_PLAIN = np.array([b in b".,;:?'\"-()" for b in range(256)])
_MARK = ~(_LETTER | _DIGIT | _SPACE)
_MARK[:32] = _MARK[127] = False


def features(text: str | None) -> np.ndarray:
    """FEATURES of a whole text; an empty or null one has zeros."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return np.zeros(len(FEATURES))
    n, k = len(raw), len(words)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = hist[hist > 0] / n
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, k)
    lines = raw.split(b"\n")
    letters = max(1, int(hist[_LETTER].sum()))
    return np.array([
        np.log1p(n), letters / n, hist[_UPPER].sum() / letters, hist[_DIGIT].sum() / n, hist[_SPACE].sum() / n, hist[10] / n, hist[46] / k,
        hist[_MARK].sum() / k, hist[_MARK & ~_PLAIN].sum() / k, hist[124] / k, share.max(), -(share * np.log(share)).sum(), n / k, len(ids) / k ** 0.9,
        np.count_nonzero(at[1:] == at[:-1]) / k, np.bincount(at).max() / k, len(set(lines)) / len(lines), sum(len(w) > 20 for w in words) / k])


class Model:
    """Logistic regression on binned features. score(X): the probability of the positive class."""

    def __init__(self, edges: list[np.ndarray], weights: np.ndarray):
        self.edges, self.weights = edges, weights

    def design(self, x: np.ndarray) -> np.ndarray:
        cols = [np.ones((len(x), 1))]
        for j, e in enumerate(self.edges):
            cols.append((np.searchsorted(e, x[:, j], "right")[:, None] == np.arange(len(e) + 1)).astype(float))
        return np.concatenate(cols, axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.design(x) @ self.weights, -30, 30)))


def _fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, steps: int = 400, decay: float = 3e-4) -> Model:
    """prior None: positives against unlabelled rows, by the logistic loss. Else the non-negative risk of the sigmoid loss
    (bounded, so that far-out positives can't outweigh an error of the prior): where the estimated risk of negatives,
    R_u - prior * R_p of the negative loss, is under 0, the step goes against it, so that the fit can't feed on its error."""
    both = np.concatenate([positive, unlabelled])
    edges = [np.unique(np.quantile(both[:, j], np.arange(1, BINS) / BINS)) for j in range(both.shape[1])]
    m = Model(edges, np.zeros(1))
    p, u = m.design(positive), m.design(unlabelled)
    w = np.zeros(p.shape[1])
    mean, var = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        zp, zu = p @ w, u @ w
        sp, su = 1 / (1 + np.exp(-np.clip(zp, -30, 30))), 1 / (1 + np.exp(-np.clip(zu, -30, 30)))
        if prior is None:
            g = (p.T @ (sp - 1) / len(p) + u.T @ su / len(u)) / 2
        else:
            down_p, down_u = p.T @ (sp * (1 - sp)) / len(p), u.T @ (su * (1 - su)) / len(u)  # gradients of the negative loss
            up = -down_p  # of the positive loss on positives
            risk = su.mean() - prior * sp.mean()
            g = prior * up + down_u - prior * down_p if risk >= 0 else prior * down_p - down_u
        g = g + decay * w
        mean, var = 0.9 * mean + 0.1 * g, 0.999 * var + 0.001 * g * g
        w = w - 0.05 * (mean / (1 - 0.9**t)) / (np.sqrt(var / (1 - 0.999**t)) + 1e-8)
    m.weights = w
    return m


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among unlabelled rows, by the smallest ratio of the two tails of a positive-against-unlabelled score.

    Above any threshold lie at least prior * (share of positives above it) of the unlabelled rows, and where a region is
    free of negatives the ratio is the prior; so the smallest ratio is no less than it, but for noise. Each half is
    scored by a fit on the other. Tails of at least half of the positives count, and each ratio less a standard error of
    both shares: a prior that is too high keeps negatives, one that is a little low costs nothing. One row of a kind
    can't be halved: 0.5.
    """
    if min(len(positive), len(unlabelled)) < 2:
        return 0.5
    sp, su = [], []
    for k in (0, 1):
        half = _fit(positive[k::2], unlabelled[k::2], None, steps=200)
        sp.append(half.score(positive[1 - k :: 2]))
        su.append(half.score(unlabelled[1 - k :: 2]))
    sp, su = np.sort(np.concatenate(sp)), np.sort(np.concatenate(su))
    cuts = np.unique(np.quantile(sp, np.linspace(0, 0.5, 51)))
    tp = 1 - np.searchsorted(sp, cuts, "left") / len(sp)
    tu = 1 - np.searchsorted(su, cuts, "left") / len(su)
    ratio = (tu - np.sqrt(tu * (1 - tu) / len(su))) / (tp + np.sqrt(tp * (1 - tp) / len(sp)))
    return float(np.clip(ratio[tp >= 0.5].min(initial=1.0), 0.02, 0.98))


def _measure(documents: DataFrame) -> DataFrame:
    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = [features(t).tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("positive"), pa.array(x, pa.list_(pa.float64()))], names=["positive", "x"])

    return documents.mapInArrow(run, "positive boolean, x array<double>")


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learns from documents (doc_id, text) and labels (doc_id, quality) outside the held-out fold. None: nothing to learn from.

    Trusted positives are rows labelled 1; unlabelled rows are any documents of the training fold, their labels unseen.
    Of each kind `sample` rows at most, chosen by a hash of the id over all rows: the classifier's bounded sample. Rows
    of one id count once; null ids and null labels take no part.
    """
    spark = documents.sparkSession
    pick = lambda df: df.where(F.col("doc_id").isNotNull() & (crc_fold("doc_id", FOLDS) != 0)).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    trusted = pick(labels.where("quality = 1").join(documents.select("doc_id"), "doc_id", "left_semi")).withColumn("positive", F.lit(True))
    plain = pick(documents).withColumn("positive", F.lit(False))
    # At most 2 * sample ids, so that they can be broadcast.
    ids = [(r[0], r[1]) for r in trusted.unionByName(plain).collect()]
    if not any(p for _, p in ids) or all(p for _, p in ids):
        return None
    kind = documents.schema["doc_id"].dataType.simpleString()
    chosen = F.broadcast(spark.createDataFrame(ids, f"doc_id {kind}, positive boolean"))
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text")).join(chosen, "doc_id").dropDuplicates(["doc_id", "positive"])
    got = _measure(rows.select("positive", "text")).collect()
    x, y = np.array([r["x"] for r in got]), np.array([r["positive"] for r in got])
    order = np.lexsort(x.T[::-1])  # rows arrive in any order; the fit must not depend on it
    x, y = x[order], y[order]
    shuffled = np.random.default_rng(0).permutation(len(x))
    x, y = x[shuffled], y[shuffled]
    return _fit(x[y], x[~y], class_prior(x[y], x[~y]))


def quality_scores(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of `documents` with score (0 to 1) and predicted (1 if score >= threshold): each text's own features alone decide.

    Null and empty texts have the features 0 and are scored like others. Without labels to learn from every score is 0.5.
    Columns of `documents` named score or predicted are replaced.
    """
    model = fit(documents, labels)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in texts:
            x = np.array([features(t) for t in some]).reshape(len(some), len(FEATURES))
            yield pd.Series(shared.value.score(x) if shared.value is not None else np.full(len(some), 0.5))

    scored = documents.drop("score", "predicted").withColumn("score", score(F.col("text").cast("string")))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality_scores(documents, labels).select("doc_id", (crc_fold("doc_id", FOLDS) == 0).alias("held_out"), "score", "predicted")
