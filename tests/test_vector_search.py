"""Searches for many vectors at once, against one search at a time."""

import numpy as np
import pytest

from quern.errors import EngineError
from quern.functions import vectors as V
from quern.queries import QUERIES


@pytest.mark.parametrize("metric", V.METRICS)
def test_search_equals_single_searches(spark, monkeypatch, metric):
    monkeypatch.setattr(V, "BLOCK", 40)
    monkeypatch.setattr(V, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=7).astype("f4").tolist()) for i in range(150)]
    rows += [(150 + i, rows[10 * i][1]) for i in range(12)]  # exact copies: equal scores
    rows += [(200 + i, rows[10][1]) for i in range(30)]
    rows += [(300, [0.0] * 7), (301, None)]
    df = spark.createDataFrame(rows, "_row_seq long, e array<float>")
    got = V.search(df, df.where("_row_seq % 10 = 0"), "e", metric, 5).collect()
    assert {r["query_id"] for r in got} == {i for i, _ in rows if i % 10 == 0}
    for q in (0, 10, 90, 200, 300):
        want = V.top_k(df, "e", dict(rows)[q], metric, 5).orderBy("rk").collect()
        found = sorted((r["rk"], r["id"], r["score"]) for r in got if r["query_id"] == q)
        assert [x[:2] for x in found] == [(r["rk"], r["_row_seq"]) for r in want]
        assert [x[2] for x in found] == pytest.approx([r["score"] for r in want], abs=1e-12)


def test_search_refuses(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0])], "_row_seq long, e array<float>")
    with pytest.raises(Exception, match="InvalidVector"):
        V.search(df, df.where("_row_seq = 0"), "e", "dot", 1).collect()
    for k, metric in ((0, "dot"), (1, "l3")):
        with pytest.raises(EngineError):
            V.search(df, df, "e", metric, k)


def test_queries_of_a_table(spark, sf_dir, tmp_path):
    assert sorted({r["query_id"] for r in QUERIES["vec_search_dot"](spark, sf_dir).collect()}) == [0, 100, 200, 300, 400]
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    for name in ("vec_topk_l2", "vec_search_l2"):
        assert QUERIES[name](spark, f"file://{tmp_path}").count() == 0
