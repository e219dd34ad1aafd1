"""The searches that end in _each answer every row whose id is divisible by 100."""

import pytest

from tessella import catalog

SF = "/root/testdata/sf0.001"
NAMES = ["vector_topk", "vector_topk_filtered", "rrf_general", "rrf_boost", "rrf_fusion", "confidence_gate", "conflict_flag"]


@pytest.mark.parametrize("name", NAMES)
def test_every_query_row_is_answered(spark, name):
    asked = {r[0] for r in spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 100 = 0").select("vec_id").collect()}
    each, one = catalog.queries()[f"{name}_each"](spark, SF), catalog.queries()[name](spark, SF)
    assert {r["qid"] for r in each.select("qid").collect()} == asked and len(asked) > 1
    assert sorted(map(tuple, each.where("qid = 0").select(*one.columns).collect())) == sorted(map(tuple, one.collect()))
