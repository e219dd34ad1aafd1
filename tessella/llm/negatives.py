"""Hard-negative mining: a PCA rotation bounds integer inner products, what can't matter is discarded early, the rest is verified."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm._common import dropped, filesystem, saved, scratch, write_whole

#: Rows that the rotation is fitted on, at most; it changes what is discarded early, never a result.
SAMPLE = 4096
#: Rows in a shard and anchors in a block: a task holds one of each; rows whose products are bounded at once.
SHARD, BLOCK, STRIDE = 8192, 2048, 1024
#: Partitions of the meetings of blocks and shards, at most.
MEETINGS = 20_000
#: Shares of the sample's energy in the leading components of the first and second partial product.
ENERGY = (0.6, 0.9)
#: Components are whole numbers of 1 / SCALE.
SCALE = 256


def usable_rows(rows: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """id, label, v (whole numbers), dim of the rows that take part.

    Rows with a null id, label or vector, or with a null or non-finite component take no part, nor do vectors whose whole
    numbers could have a squared length of 2 ** 55 or more: products of the others, times 100, fit 64 bits.
    """
    v = F.col(vec_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    length = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * SCALE * (x.cast("double") * SCALE) + 1.0)
    good = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(length < float(1 << 54), F.lit(False))
    return rows.where(good).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("int")).alias("v"), F.size(v).alias("dim"))


def fit_rotation(rows: DataFrame, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """By dimension, an orthogonal matrix whose first columns have most of the energy of a bounded sample (rows of the smallest hash of their id)."""
    by_dim: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("dim", "v").collect():
        by_dim.setdefault(r["dim"], []).append(r["v"])
    return {d: rotation_of(np.array(vs, float).reshape(len(vs), d)) for d, vs in by_dim.items()}


def rotation_of(x: np.ndarray) -> np.ndarray:
    _, vectors = np.linalg.eigh(x.T @ x)
    return np.ascontiguousarray(vectors[:, ::-1])


def stages_of(x: np.ndarray) -> list[int]:
    """Leading components of the partial products, from the energy of rotated rows; none where they would be nearly all."""
    energy = (x * x).sum(0)
    total = np.cumsum(energy) / max(energy.sum(), 1e-300)
    cuts = {int(np.searchsorted(total, e)) + 1 for e in ENERGY}
    return sorted(c for c in cuts if c <= 0.8 * x.shape[1])


class Side:
    """Whole-number vectors, their rotation, and what bounds need: residual norms by stage, and norms for the rounding slack."""

    def __init__(self, v: np.ndarray, rotation: np.ndarray):
        self.v, self.x = v, v @ rotation
        self.norm = np.sqrt((v.astype(float) ** 2).sum(1))
        squares = self.x * self.x
        self.tail = np.sqrt(np.cumsum(squares[:, ::-1], 1)[:, ::-1])  # from each component on

    def rest(self, k: int) -> np.ndarray:
        return self.tail[:, k] if k < self.x.shape[1] else np.zeros(len(self.x))


def slack_of(rotation: np.ndarray) -> float:
    """Bound, as a share of the product of two norms, of what rounding and a rotation that isn't quite orthogonal can add to a bound."""
    d = max(1, len(rotation))
    away = np.abs(rotation.T @ rotation - np.eye(len(rotation))).sum(1).max(initial=0.0)
    return float(away) + 16 * np.finfo(float).eps * d * d


def exact_products(a: np.ndarray, b: np.ndarray, norms: float) -> np.ndarray:
    """Inner products of whole numbers; where the norms say that all sums stay below 2 ** 53, doubles have them exactly."""
    if norms < 2.0**52:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


def bounded_pairs(anchors: Side, rows: Side, part: slice, stages: list[int], slack: float, alive: np.ndarray, wanted):
    """Anchor and row numbers and exact products of the pairs that no bound rules out.

    `alive` has the pairs in question; `wanted(low, high)` tells which of them may still matter, given bounds of their products.
    Each stage adds the products of more leading components; the norms of what is left bound the rest.
    """
    done, partial = 0, np.zeros(alive.shape)
    columns = np.arange(alive.shape[1])
    for k in stages:
        keep = alive.any(0)
        alive, partial, columns = alive[:, keep], partial[:, keep], columns[keep]
        if not len(columns):
            break
        x = rows.x[part][columns]
        partial = partial + anchors.x[:, done:k] @ x[:, done:k].T
        done = k
        around = anchors.rest(k)[:, None] * rows.rest(k)[part][columns][None] * (1 + 1e-9) + slack * anchors.norm[:, None] * rows.norm[part][columns][None]
        alive = alive & wanted(partial - around, partial + around)
    keep = alive.any(0)
    alive, columns = alive[:, keep], columns[keep]
    q, c = np.nonzero(alive)
    if not len(q):
        return q, columns[c], np.zeros(0, np.int64)
    v = rows.v[part][columns]
    if len(q) * 8 < alive.size:
        products = np.empty(len(q), np.int64)
        for a in range(0, len(q), 1 << 16):
            z = slice(a, a + (1 << 16))
            products[z] = np.einsum("ij,ij->i", anchors.v[q[z]].astype(np.int64), v[c[z]].astype(np.int64))
    else:
        products = exact_products(anchors.v, v, float(anchors.norm.max() * rows.norm[part][columns].max()))[q, c]
    return q, columns[c], products


class Best:
    """The k best rows of each key: higher scores first, then smaller rows (rows are numbered by id)."""

    def __init__(self, keys: int, k: int):
        self.k, self.key, self.row, self.score = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least = np.full(keys, -(2**62), np.int64)

    def add(self, key, row, score) -> None:
        key, row, score = np.concatenate([self.key, key]), np.concatenate([self.row, row]), np.concatenate([self.score, score])
        order = np.lexsort((row, -score, key))
        key, row, score = key[order], row[order], score[order]
        first = np.searchsorted(key, key)
        place = np.arange(len(key)) - first
        full = place == self.k - 1
        self.least[key[full]] = score[full]  # a row of a later number must be above it
        keep = place < self.k
        self.key, self.row, self.score = key[keep], row[keep], score[keep]


def nearest_same(anchors: Side, anchor_ids, anchor_labels, rows: Side, ids, labels, k: int, stages, slack) -> Best:
    """Of each anchor, the k rows of its label and another id of the highest products. Rows are sorted by id."""
    best = Best(len(anchor_ids), k)
    for at in range(0, len(ids), STRIDE):
        part = slice(at, at + STRIDE)
        alive = (anchor_labels[:, None] == labels[part][None]) & (anchor_ids[:, None] != ids[part][None])
        q, c, score = bounded_pairs(anchors, rows, part, stages, slack, alive, lambda low, high: high > best.least[:, None])
        keep = score > best.least[q]
        best.add(q[keep], at + c[keep], score[keep])
    return best


def nearest_within(anchors: Side, anchor_labels, lows, highs, rows: Side, labels, k: int, stages, slack) -> Best:
    """Of each anchor and window (lows and highs: anchors x windows), the k rows of another label of the highest products within it."""
    n, windows = lows.shape
    best = Best(n * windows, k)
    for at in range(0, len(labels), STRIDE):
        part = slice(at, at + STRIDE)
        least = np.maximum(lows, best.least.reshape(n, windows) + 1)

        def wanted(low, high, least=least):
            out = np.zeros(low.shape, bool)
            for w in range(windows):
                out |= (high >= least[:, w, None]) & (low <= highs[:, w, None])
            return out

        q, c, score = bounded_pairs(anchors, rows, part, stages, slack, anchor_labels[:, None] != labels[part][None], wanted)
        found = [np.flatnonzero((score >= least[q, w]) & (score <= highs[q, w])) for w in range(windows)]
        best.add(np.concatenate([q[f] * windows + w for w, f in enumerate(found)]), at + np.concatenate([c[f] for f in found]), np.concatenate([score[f] for f in found]))
    return best


def _whole(column, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(len(column), dim)


def _write_shards(rows: DataFrame, shards: int, folder: str) -> DataFrame:
    """Writes each shard's rows in order of id once, as folder/dimension-shard.npz; the written table of them (dim, shard)."""

    def build(key, table):
        import pyarrow as pa

        dim, shard = (k.as_py() for k in key)
        ids = table.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        np.savez(out := io.BytesIO(), ids=ids[order], labels=table.column("label").to_numpy()[order], v=_whole(table.column("v"), dim)[order])
        write_whole(f"{folder}/{dim}-{shard}.npz", [out.getvalue()])
        return pa.table({"dim_": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int32())})

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id", "label", "v"), F.lit(shards)).cast("int"))
    return saved(dealt.groupBy("dim", "shard").applyInArrow(build, "dim_ int, shard int"), "negative-shards")


def _read_shard(folder: str, dim: int, shard: int):
    system, path = filesystem(f"{folder}/{dim}-{shard}.npz")
    with system.open_input_stream(path, compression=None) as f:
        got = np.load(io.BytesIO(f.read()))
    return got["ids"], got["labels"], got["v"]


def hard_negatives(rows: DataFrame, is_anchor, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", shard: int = SHARD) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows where `is_anchor` (of the column id) holds: a stated set, which meets all rows in blocks. An anchor's
    positives are its first rows of the same label and another id by integer inner product (ties to the smaller id); the
    negatives of each are the first rows of another label whose product is `low` to `high` percent of the positive's.

    Every row is written once to a shard by a hash of its content; each block of anchors meets each shard twice, for
    positives and for negatives. There, products of leading components after a PCA rotation and the norms of the rest bound
    each product, pairs that can't be among the first ones are discarded, and the others' products are computed in whole
    numbers: results are exact whatever the rotation.

    Rows that usable_rows leaves out take no part. Only vectors of one length meet; empty ones have products of 0. Repeated
    anchors count once, two anchors of one id are mined each by itself; repeated rows are rows, so they may fill several ranks.
    Without positives, or without rows within the window, an anchor has no result.
    """
    spark = rows.sparkSession
    rows = usable_rows(rows, id_col, vec_col, label_col)
    total = rows.count()
    rotations = spark.sparkContext.broadcast(fit_rotation(rows))
    folder = scratch(spark, "negative-rows")
    shards = _write_shards(rows, max(1, -(-total // shard)), folder)
    anchors = rows.where(is_anchor(F.col("id"))).dropDuplicates(["id", "label", "v"]).withColumn("anchor", F.xxhash64("label", "v"))
    anchors = saved(anchors, "negative-anchors")
    blocks = max(1, -(-anchors.count() // BLOCK))
    anchors = anchors.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))

    def meeting(df):
        """Each block of anchors with each shard; a fixed number of partitions, as a block has few bytes and much work."""
        asked = df.join(shards, F.col("dim") == F.col("dim_")).drop("dim_")
        return asked.repartition(min(MEETINGS, -(-total // shard) * blocks + 1), "dim", "shard", "block").groupBy("dim", "shard", "block")

    def sides(key, table):
        dim, shard, _ = (k.as_py() for k in key)
        rotation = rotations.value.get(dim)
        rotation = np.eye(dim) if rotation is None else rotation
        ids, labels, v = _read_shard(folder, dim, shard)
        other = Side(v, rotation)
        return Side(_whole(table.column("v"), dim), rotation), other, ids, labels, stages_of(other.x), slack_of(rotation)

    def find_positives(key, table):
        import pyarrow as pa

        own, other, ids, labels, stages, slack = sides(key, table)
        a = table.column("id").to_numpy()
        best = nearest_same(own, a, table.column("label").to_numpy(), other, ids, labels, positives, stages, slack)
        return pa.table({"id": a[best.key], "anchor": table.column("anchor").to_numpy()[best.key], "positive_id": ids[best.row], "positive_score": best.score})

    def find_negatives(key, table):
        import pyarrow as pa

        own, other, ids, labels, stages, slack = sides(key, table)
        lists = table.column("found").to_pylist()
        scores = np.full((len(lists), positives), -1, np.int64)  # no product is within the window of a negative one
        for i, found in enumerate(lists):
            scores[i, : len(found)] = [p["positive_score"] for p in found]
        lows, highs = -(-low * scores // 100), high * scores // 100
        lows[scores < 0], highs[scores < 0] = 2**61, -(2**61)
        best = nearest_within(own, table.column("label").to_numpy(), lows, highs, other, labels, negatives, stages, slack)
        q, w = np.divmod(best.key, positives)
        picked = [lists[i][j] for i, j in zip(q.tolist(), w.tolist(), strict=True)]
        return pa.table(
            {"anchor_id": table.column("id").to_numpy()[q], "anchor": table.column("anchor").to_numpy()[q], "place": pa.array(w, pa.int32()), "positive_id": pa.array([p["positive_id"] for p in picked], pa.int64()), "positive_score": pa.array([p["positive_score"] for p in picked], pa.int64()), "negative_id": ids[best.row], "negative_score": best.score}
        )

    def first(df, keys, score, then, k, name):
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), then))).where(F.col(name) <= k)

    found = first(meeting(anchors).applyInArrow(find_positives, "id long, anchor long, positive_id long, positive_score long"), ["id", "anchor"], "positive_score", "positive_id", positives, "place")
    found = found.groupBy("id", "anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score"))), lambda p: F.struct(p["positive_id"].alias("positive_id"), p["positive_score"].alias("positive_score"))).alias("found"))
    with_found = saved(anchors.join(found, ["id", "anchor"]), "negative-positives")
    mined = meeting(with_found).applyInArrow(find_negatives, "anchor_id long, anchor long, place int, positive_id long, positive_score long, negative_id long, negative_score long")
    mined = first(mined, ["anchor_id", "anchor", "place"], "negative_score", "negative_id", negatives, "rank")
    out = saved(mined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "hard-negatives")
    dropped(anchors, shards, with_found)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return out


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), lambda i: i % 100 == 0)


OP11_SQL = """
WITH usable AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
        list_sum(list_transform(generate_series(1, len(a.v)), lambda i: a.v[i] * b.v[i]))::BIGINT AS score
    FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
positives AS (SELECT anchor_id, other_id, score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.other_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY s.score DESC, s.other_id)::INTEGER AS rank,
    s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY rank <= 10
"""
