"""What the near-duplicate stage drops."""

import numpy as np

import corpus_pipeline as P

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def kept(spark, tmp_path, rows):
    """The stage's rows, read from a file as the pipeline does."""
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).coalesce(2).write.parquet(f"file://{tmp_path}/d")
    out = P.drop_near_copies(spark, spark.read.parquet(f"file://{tmp_path}/d"), "")
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    return sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))


def test_threshold_is_80_per_cent(spark, tmp_path):
    rng, rows = np.random.default_rng(4), []
    for g in range(20):  # 100 shingles; a shift of 10 shares 90 of 110: 0.818, one of 12 88 of 112: 0.786
        words = [f"g{g}w{x}" for x in rng.permutation(200)]
        shift = 10 if g % 2 else 12
        rows += [(2 * g, " ".join(words[:104])), (2 * g + 1, " ".join(words[shift : shift + 104]))]
    got = kept(spark, tmp_path, rows)
    assert [i for i, _ in got] == [i for i in range(40) if not (i % 2 and i // 2 % 2)]


def test_rows_are_dropped_not_ids(spark, tmp_path):
    rng = np.random.default_rng(5)
    make = lambda k: [f"{k}w{x}" for x in rng.permutation(120)]
    near = lambda words, k: " ".join([*words[:-1], f"x{k}"])
    a, b, c, d = (make(k) for k in "abcd")
    rows = [(None, near(a, k)) for k in range(3)]  # near copies without ids
    rows += [(7, near(b, k)) for k in range(3)]  # near copies that share an id
    rows += [(1, near(c, 0)), (9, near(c, 1)), (9, " ".join(d))]  # an id with a near copy and a text of its own
    rows += [(5, ""), (None, ""), (None, None)]
    got = kept(spark, tmp_path, rows)
    assert [i for i, _ in got if i is not None] == [1, 5, 7, 9] and (1, near(c, 0)) in got and (9, " ".join(d)) in got
    assert sum((t or "").startswith("aw") for _, t in got) == 1 and sum((t or "").startswith("bw") for _, t in got) == 1
    assert sum(not t for _, t in got) == 3
