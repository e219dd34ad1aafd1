"""The blocked search against all pairs, whatever the sizes of shards and blocks, and interval joins against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators.intervals import join_overlaps, join_ranges
from tessella.operators.search import search


def table():
    rng = np.random.default_rng(11)
    rows = [(i, [float(x) for x in rng.normal(size=5)], int(rng.integers(0, 4))) for i in range(300)]
    rows += [(400 + i, rows[7][1], 1) for i in range(20)]  # ties
    rows += [(500, None, 1), (501, [], 1), (510, [0.0] * 5, 1), (520, [float("nan")] * 5, 1), (530, [1.0, None, 1.0, 1.0, 1.0], 2), (None, [1.0] * 5, 1), (540, [1.0, 2.0], 1), (541, [2.0, 1.0], None), (550, [1.0] * 5, None)]
    return rows


@pytest.mark.parametrize(("shard", "block"), [(40, 7), (10**6, 10**6)])
def test_search_equals_all_pairs(spark, shard, block):
    rows = table()
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, dim string").repartition(4)
    label = F.col("label")
    got = search(df, F.col("vec_id") % 10 == 0, [(F.lit(0), F.lit(0)), (label, label), (F.when(label < 2, 0), F.when(F.col("vec_id") % 20 == 0, 0))], 6, tag=label, shard=shard, block=block)
    good = [(i, np.array(v), lab) for i, v, lab in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    want = []
    for q, v, mine in good:
        if q % 10 == 0:
            scored = [(-round(float(v @ w / np.sqrt((v @ v) * (w @ w))), 6), i, lab) for i, w, lab in good if i != q and len(w) == len(v)]
            for b, fits in enumerate((lambda lab: True, lambda lab: lab is not None and lab == mine, lambda lab, q=q: lab is not None and lab < 2 and q % 20 == 0)):
                want += [(q, b, p, i, -s, lab) for p, (s, i, lab) in enumerate(sorted(x for x in scored if fits(x[2]))[:6], 1)] if b or True else []
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert search(df.limit(0), F.lit(True), [(F.lit(0), F.lit(0))], 3).count() == 0


@pytest.mark.parametrize("levels", [1, 4, 16])
def test_ranges_equal_all_pairs(spark, levels):
    rng = np.random.default_rng(levels)
    values = [(i, float(v), int(k)) for i, (v, k) in enumerate(zip(np.round(rng.normal(0, 40, 300)), rng.integers(0, 2, 300), strict=True))] + [(900, None, 0), (901, 0.0, None)]
    ends = [(float(a), float(a + w), int(k)) for a, w, k in zip(np.round(rng.normal(0, 60, 80)), np.round(rng.exponential(20, 80)), rng.integers(0, 2, 80), strict=True)]
    ends += [(None, 3.0, 0), (5.0, None, 1), (None, None, 0), (9.0, 2.0, 0), (7.0, 7.0, 1), (-1e9, 1e9, 1), (1e9, None, 0), (0.0, 1.0, None), (7.0, 7.0, 1)]
    ranges = [(100 + i, *e) for i, e in enumerate(ends)]
    v, r = spark.createDataFrame(values, "id long, v double, k int"), spark.createDataFrame(ranges, "rid long, lo double, hi double, k int")
    inside = lambda x, lo, hi: x is not None and (lo is None or x >= lo) and (hi is None or x <= hi)
    got = sorted((x["id"], x["rid"]) for x in join_ranges(v, r, "v", "lo", "hi", ["k"], levels).collect())
    assert got == sorted((i, j) for i, x, k in values for j, lo, hi, m in ranges if k is not None and k == m and inside(x, lo, hi)) and len(got) > 300
    free = sorted((x["id"], x["rid"]) for x in join_ranges(v.drop("k"), r.drop("k"), "v", "lo", "hi", None, levels).collect())
    assert free == sorted((i, j) for i, x, _ in values for j, lo, hi, _ in ranges if inside(x, lo, hi))
    assert join_ranges(v.limit(0), r, "v", "lo", "hi", ["k"]).count() == 0 == join_ranges(v, r.limit(0), "v", "lo", "hi", ["k"]).count()


def test_overlaps_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    spans = lambda n, at: [(at + i, float(a), float(a + w) if w < 9 else None) for i, (a, w) in enumerate(zip(np.round(rng.normal(0, 20, n)), np.round(rng.exponential(4, n)), strict=True))]
    a, b = [*spans(60, 0), (60, None, 4.0)], spans(60, 100)
    got = join_overlaps(spark.createDataFrame(a, "id long, s double, e double"), spark.createDataFrame(b, "rid long, lo double, hi double"), "s", "e", "lo", "hi").collect()
    want = [(i, j) for i, s, e in a for j, lo, hi in b if s is not None and (hi is None or s <= hi) and (e is None or e >= lo)]
    assert sorted((x["id"], x["rid"]) for x in got) == sorted(want)
