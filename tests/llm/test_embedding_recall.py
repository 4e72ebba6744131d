"""Pairs at the threshold are found, among vectors of the production dimension."""

import numpy as np

from quern.llm.embedding_dedup import embedding_dedup


def test_pairs_at_a_cosine_of_09(spark):
    """400 pairs at 0.9005, 400 at 0.8995, and 2,400 unrelated vectors: at least 99 of 100 of the former are found, none of the latter."""
    rng = np.random.default_rng(12)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a = unit(rng.standard_normal((800, 64)))
    side = rng.standard_normal((800, 64))
    side = unit(side - (side * a).sum(1, keepdims=True) * a)
    cosine = np.repeat([0.9005, 0.8995], 400)[:, None]
    b = cosine * a + np.sqrt(1 - cosine**2) * side
    every = np.concatenate([a, b, unit(rng.standard_normal((2400, 64)))])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(every)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in embedding_dedup(rows).collect()}
    near = every @ every.T >= 0.9
    np.fill_diagonal(near, False)
    assert near.sum() == 800
    assert all(got[i]["n_links"] <= near[i].sum() for i in got)
    found = sum(got[800 + i]["component_id"] == i for i in range(400))
    assert found >= 396, found
