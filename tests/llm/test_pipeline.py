"""The pipeline's stages, each against what it says, on documents made here."""

import numpy as np
import pytest

import corpus_pipeline as P
from quern.llm.mixing import mix_sources


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(9)
    words, bad = [f"w{i}" for i in range(3000)], ["vile", "rotten", "foul"]
    rows, labels = [], []
    for i in range(400):
        text = rng.choice(words, rng.integers(20, 120)).tolist()
        if i % 6 == 0:
            text[3:3] = rng.choice(bad, 3, replace=False).tolist()
        rows.append((i, " ".join(text), "en", f"s{i % 4}", 1))
        labels.append((i, 1, int(i % 6 == 0)))
    rows += [(1000 + k, rows[1][1], "en", "s1", 1) for k in range(5)]
    near = rows[2][1].split()
    rows += [(2000 + k, " ".join([*near[:-1], f"x{k}"]), "en", "s2", 1) for k in range(4)]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{folder}/labels.parquet")
    return f"file://{folder}", rows


def test_stages(spark, corpus, tmp_path):
    sf_dir, rows = corpus
    docs, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in P.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"file://{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"file://{tmp_path}/{name}")
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns and docs.join(before, columns, "left_anti").count() == 0
        seen[name] = docs
    ids = {n: sorted(r["doc_id"] for r in d.select("doc_id").collect()) for n, d in seen.items()}
    toxic = {i for i in range(400) if i % 6 == 0}
    assert len(toxic & set(ids["toxicity"])) <= 6 and len(set(range(400)) - toxic - set(ids["toxicity"])) <= 6
    assert [i for i in ids["exact_dedup"] if i in (1, *range(1000, 1005))] == [1004]
    assert len(ids["exact_dedup"]) == len(ids["toxicity"]) - 5
    assert [i for i in ids["near_dedup"] if i in (2, *range(2000, 2004))] == [2] and len(ids["near_dedup"]) == len(ids["exact_dedup"]) - 4
    copies = {r["doc_id"]: r["copies"] for r in mix_sources(seen["near_dedup"]).collect()}
    assert ids["mix_sources"] == sorted(i for i, n in copies.items() for _ in range(n))
    packed = seen["pack_best_fit"].collect()
    assert sorted(r["doc_id"] for r in packed if r["piece"] == 0) == ids["mix_sources"]


def test_run_gives_the_last_stage(spark, corpus):
    assert P.ORACLE_SQL is None
    got = P.run(spark, corpus[0])
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(got.columns) and got.count() > 0
