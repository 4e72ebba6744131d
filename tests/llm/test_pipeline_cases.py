"""Each pipeline stage on nulls, empty tables, long texts, ties, repeated rows and clashing column names."""

import pytest

import corpus_pipeline as P
from quern.llm.common import numbered

CLASHES = ("row", "copies", "score", "predicted", "held_out", "_row", "_copies", "node", "component_id", "kept", "u.v", "size", "_c0")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"`{c}` string" for c in CLASHES)


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(1, 0, 0), (2, 1, 1), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"file://{folder}/labels.parquet")
    return f"file://{folder}"


def rows():
    long = " ".join(f"l{k}" for k in range(40_000))
    texts = [(1, "one plain text of a few words"), (2, "one plain text of a few words"), (2, "one plain text of a few words"), (3, None), (4, ""), (None, "no id here at all, is there"), (None, None), (5, long), (6, " \t\n"), (6, "x")]
    return [(i, t, None, None if k % 4 == 0 else "s", None, *[f"{c}-{k}" for c in CLASHES]) for k, (i, t) in enumerate(texts)]


@pytest.mark.parametrize("stored", [True, False])
@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_stage(spark, sf, tmp_path, name, stored):
    stage = dict(P.STAGES)[name]
    for given in (rows(), []):
        docs = spark.createDataFrame(given, SCHEMA)
        if stored:
            docs.repartition(3).write.mode("overwrite").parquet(f"file://{tmp_path}/docs")
            docs = spark.read.parquet(f"file://{tmp_path}/docs")
        out = stage(spark, docs, sf)
        got = [tuple(r) for r in out.collect()]
        if name == "pack_best_fit":
            assert len({r[0] for r in got}) == len({r[0] for r in given}) and len(got) >= len(given)
            continue
        assert out.columns == docs.columns and set(got) <= set(given), name  # values of clashing columns are the rows' own
        if not given:
            assert got == []
        elif name == "exact_dedup":
            assert len(got) == 6 and sorted(r[0] or 0 for r in got if r[1] and r[1].startswith("one")) == [2]
        elif name == "near_dedup":
            assert len(got) == len(given) - 2
        elif name == "toxicity":
            assert len(got) in (0, len(given)) or len(set(got)) == len(got)


def test_rows_keep_their_numbers_however_they_are_scanned(spark, tmp_path):
    spark.range(3000, numPartitions=3).write.parquet(f"file://{tmp_path}/r")
    seen = []
    for size in ("128m", "2k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        seen.append({(r["id"], tuple(r["n"])) for r in numbered(spark.read.parquet(f"file://{tmp_path}/r"), "n").collect()})
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen[0] == seen[1] and len({n for _, n in seen[0]}) == 3000
