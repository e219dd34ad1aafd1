"""Exact search by cosine: blocks of queries against shards of rows as matrix products, a list of the best for each, merged by query."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows in a shard and queries in a block: a task holds one of each; rows whose products are held at once.
SHARD, BLOCK, STRIDE = 16_384, 2_048, 1_024


def _valid(df: DataFrame, id_col: Column, vec: Column, keys: list[Column], *more: Column) -> DataFrame:
    """Rows with an id and a vector of finite numbers that isn't zero or empty, each branch's key (null: not in it) beside them."""
    good = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    named = [k.cast("long").alias(f"k{i}") for i, k in enumerate(keys)]
    return df.where(id_col.isNotNull() & F.coalesce(good, F.lit(False))).select(id_col.cast("long").alias("id"), vec.cast("array<double>").alias("v"), F.size(vec).alias("dim"), *named, *more)


def _best(scores: np.ndarray, alive: np.ndarray, ids: np.ndarray, k: int):
    """Query rows, columns and scores of each query's k best columns that are alive: the highest first, ties to the smaller id."""
    s = np.where(alive, scores, -np.inf)
    if s.shape[1] > k:
        alive = alive & (s >= np.partition(s, -k, axis=1)[:, -k][:, None])
    q, c = np.nonzero(alive)
    order = np.lexsort((ids[c], -s[q, c], q))
    q, c = q[order], c[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], c[keep], s[q[keep], c[keep]]


def search(rows: DataFrame, asked: Column, branches: list[tuple[Column | str, Column | str]], k: int, id_col: str = "vec_id", vec_col: str = "embedding", tag: Column | None = None, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """qid, branch, place, vec_id, score, tag: for every row that is `asked` and every branch, the k rows of the highest cosine.

    A branch is a pair of keys (columns or SQL), of the rows searched and of the rows that ask: they meet where the keys are equal and not null,
    so that (0, 0) is all rows, (label, label) those of the asking row's label. Scores are rounded to six places, ties go to the
    smaller id, a row doesn't find its own id. Rows without an id, or whose vector is null, empty, zero or not finite, take no
    part; only vectors of one length meet; `tag` (a long) of a found row is given with it.

    Rows are dealt to shards of about `shard` rows by a hash and asking rows to blocks of about `block`; each shard meets each
    block in one task: as a stated set, the queries are held against all rows. Nothing is broadcast, and of a task's products only k rows a
    query and branch leave it.
    """
    ids, vec = F.col(id_col), F.col(vec_col)
    branches = [tuple(F.expr(x) if isinstance(x, str) else x for x in b) for b in branches]
    tagged = (F.lit(None) if tag is None else tag).cast("long").alias("tag")
    searched = _valid(rows, ids, vec, [b for b, _ in branches], tagged)
    asking = _valid(rows.where(asked), ids, vec, [b for _, b in branches])
    shards = max(1, -(-searched.count() // shard))
    blocks = max(1, -(-asking.count() // block))
    of = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = searched.withColumn("shard", of(shards)).withColumn("block", every(blocks))
    right = asking.withColumn("block", of(blocks)).withColumn("shard", every(shards))
    names = [f"k{i}" for i in range(len(branches))]

    def matrix(table):
        column = table.column("v").combine_chunks()
        return column.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)

    def meet(found, asks):
        import pyarrow as pa

        out = {"qid": [], "branch": [], "vec_id": [], "score": [], "tag": []}
        if found.num_rows and asks.num_rows:
            x, q = matrix(found), matrix(asks)
            ids, qids = found.column("id").to_numpy(), asks.column("id").to_numpy()
            tags = found.column("tag").to_numpy(zero_copy_only=False)
            keys = [(found.column(n).to_numpy(zero_copy_only=False), asks.column(n).to_numpy(zero_copy_only=False)) for n in names]
            nx, nq = (x * x).sum(1), (q * q).sum(1)
            parts = [[] for _ in names]
            for at in range(0, len(x), STRIDE):
                z = slice(at, at + STRIDE)
                scores = np.round((q @ x[z].T) / np.sqrt(nq[:, None] * nx[z][None]), 6)
                other = qids[:, None] != ids[z][None]
                for b, (own, theirs) in enumerate(keys):
                    a, c, s = _best(scores, other & (theirs[:, None] == own[z][None]), ids[z], k)  # null keys are NaN, equal to nothing
                    parts[b].append((a, c + at, s))
            for b, found_parts in enumerate(parts):
                a, c, s = (np.concatenate(p) for p in zip(*found_parts, strict=True))
                order = np.lexsort((ids[c], -s, a))
                a, c, s = a[order], c[order], s[order]
                keep = np.arange(len(a)) - np.searchsorted(a, a) < k
                for name, values in (("qid", qids[a[keep]]), ("branch", np.full(keep.sum(), b)), ("vec_id", ids[c[keep]]), ("score", s[keep]), ("tag", tags[c[keep]])):
                    out[name].append(values)
        join = lambda name, kind: pa.array(np.concatenate(out[name]) if out[name] else [], kind, from_pandas=True)
        return pa.table({"qid": join("qid", pa.int64()), "branch": join("branch", pa.int32()), "vec_id": join("vec_id", pa.int64()), "score": join("score", pa.float64()), "tag": pa.array([None if t != t else int(t) for p in out["tag"] for t in p.tolist()], pa.int64())})

    by = ("dim", "shard", "block")
    met = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, "qid long, branch int, vec_id long, score double, tag long")
    place = F.row_number().over(Window.partitionBy("qid", "branch").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("place", place).where(F.col("place") <= k).select("qid", "branch", "place", "vec_id", "score", "tag")
