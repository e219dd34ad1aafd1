"""Approximate nearest neighbours by a permutation index: vectors as ordered lists of their nearest pivots."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm._common import filesystem, saved, scratch, write_whole

#: Pivots, the nearest of them that stand in a vector's list, and rows from which pivots are drawn, at most.
PIVOTS, PREFIX, SAMPLE = 256, 128, 4096
#: Share of a shard's vectors, and vectors at least, whose distance is computed after the ranking by footrule.
RERANK, RERANK_LEAST = 0.12, 50
#: Vectors in a shard and queries in a block: one task holds one shard and one block.
SHARD, BLOCK = 8192, 2048


def valid_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows with an id whose vector isn't null, empty or zero and holds finite numbers only, as id, v, dim."""
    v = F.col(vec_col)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"), F.size(v).alias("dim"))


def choose_pivots(rows: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """Pivots by dimension: distinct vectors of a bounded sample (rows of the smallest hash of their id), at most `pivots`."""
    got = rows.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    by_dim: dict[int, list] = {}
    for r in got:
        by_dim.setdefault(r["dim"], []).append(tuple(r["v"]))
    return {d: np.array(list(dict.fromkeys(vs))[:pivots]) for d, vs in by_dim.items()}


def pivot_order(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Each row's nearest pivots, nearest first; ties to the smaller pivot."""
    d = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * x @ pivots.T
    return np.argsort(d, axis=1, kind="stable")[:, :prefix]


class Shard:
    """Inverted files over some vectors: for each pivot the rows whose list has it, and at which place."""

    FIELDS = ("ids", "x", "pivots", "rows", "places", "ends")

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray | None, prefix: int):
        """Without pivots, rows of the shard's own are the pivots: those of the smallest ids."""
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        self.pivots = pivots if pivots is not None and len(pivots) else np.unique(self.x[:PIVOTS], axis=0)
        self.prefix = min(prefix, len(self.pivots))
        flat = pivot_order(self.x, self.pivots, self.prefix).ravel()
        by_pivot = np.argsort(flat, kind="stable")
        self.rows, self.places = by_pivot // self.prefix, by_pivot % self.prefix
        self.ends = np.searchsorted(flat[by_pivot], np.arange(len(self.pivots) + 1))

    def dump(self) -> bytes:
        np.savez(out := io.BytesIO(), prefix=self.prefix, **{k: getattr(self, k) for k in self.FIELDS})
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Shard:
        self, got = cls.__new__(cls), np.load(io.BytesIO(raw))
        self.prefix = int(got["prefix"])
        for k in cls.FIELDS:
            setattr(self, k, got[k])
        return self

    def candidates(self, order: np.ndarray, n: int) -> np.ndarray:
        """The n rows of the smallest footrule distance to a query's list, ties to the smaller id.

        With the place `prefix` for a pivot that a list lacks, the footrule distance is a constant less twice the sum of
        prefix - max(both places) over the pivots that both lists have; so only their files are read.
        """
        shared = np.zeros(len(self.ids), np.int64)
        for place, pivot in enumerate(order.tolist()):
            a, z = self.ends[pivot], self.ends[pivot + 1]
            shared[self.rows[a:z]] += self.prefix - np.maximum(self.places[a:z], place)
        key = -shared * len(self.ids) + np.arange(len(self.ids))
        return np.argpartition(key, n - 1)[:n] if n < len(key) else np.arange(len(key))

    def search(self, query_ids: np.ndarray, q: np.ndarray, k: int, rerank: float, least: int):
        """query id, ids, distances: of each query the k nearest of those whose footrule distance is smallest."""
        n = max(least, int(np.ceil(rerank * len(self.ids))))
        for i, order in enumerate(pivot_order(q, self.pivots, self.prefix)):
            rows = self.candidates(order, n + 1)  # the query itself may be one
            rows = rows[self.ids[rows] != query_ids[i]]
            d = self.x[rows] - q[i]
            d = np.sqrt((d * d).sum(1))
            best = np.lexsort((self.ids[rows], d))[:k]
            yield int(query_ids[i]), self.ids[rows][best], d[best]


def _matrix(table, dim: int) -> np.ndarray:
    return table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, dim)


def build_index(rows: DataFrame, shards: int, folder: str, prefix: int = PREFIX) -> DataFrame:
    """Writes the inverted files of each shard once, as folder/dimension-shard.npz; returns the written table of shards (dim, shard)."""
    shared = rows.sparkSession.sparkContext.broadcast(choose_pivots(rows))

    def build(key, table):
        import pyarrow as pa

        dim, shard = (k.as_py() for k in key)
        built = Shard(table.column("id").to_numpy(), _matrix(table, dim), shared.value.get(dim), prefix)
        write_whole(f"{folder}/{dim}-{shard}.npz", [built.dump()])
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int32())})

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    return saved(dealt.groupBy("dim", "shard").applyInArrow(build, "dim int, shard int"), "nearest-shards")


def nearest(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", prefix: int = PREFIX, rerank: float = RERANK, least: int = RERANK_LEAST) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where `is_query` (of the column id) holds, its k nearest others found.

    Every valid row is indexed: rows are dealt to shards by a hash of their id, and each shard's inverted files are
    written once. Each block of queries meets each shard: there candidates are ranked by footrule, the nearest share of
    them (`least` at least) is reranked by Euclidean distance in double precision, and k of them leave the shard. Only
    vectors of the same dimension meet. Null ids and invalid vectors take no part; rows of one id are never each other's
    neighbours; other repeated vectors are, ties to the smaller id.
    """
    rows = valid_vectors(vectors, id_col, vec_col)
    total, queries = rows.agg(F.count("*"), F.count_if(is_query(F.col("id")))).first()
    folder = scratch(vectors.sparkSession, "nearest-index")
    shards = build_index(rows, max(1, -(-total // SHARD)), folder, prefix)
    # The stated query set against all rows: each block of queries goes to each shard of its dimension.
    asked = rows.where(is_query(F.col("id"))).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-queries // BLOCK)))).cast("int"))
    asked = asked.join(shards.withColumnRenamed("dim", "dim_"), F.col("dim") == F.col("dim_")).select("id", "v", "dim", "shard", "block")

    def search(key, table):
        import pyarrow as pa

        dim, shard, _ = (x.as_py() for x in key)
        system, path = filesystem(f"{folder}/{dim}-{shard}.npz")
        with system.open_input_stream(path, compression=None) as f:
            built = Shard.load(f.read())
        found = [(q, i, d) for q, ids, ds in built.search(table.column("id").to_numpy(), _matrix(table, dim), k, rerank, least) for i, d in zip(ids.tolist(), ds.tolist(), strict=True)]
        q, i, d = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(i, pa.int64()), "score": pa.array(d, pa.float64())})

    found = asked.groupBy("dim", "shard", "block").applyInArrow(search, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_nearest(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 100 == 0)
