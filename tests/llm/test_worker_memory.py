"""What workers hold: merges by parts of the keys, and memory given back after a task."""

import subprocess
import sys
import tracemalloc

import numpy as np

from quern.llm import common, lm_score


def test_merged_parts_are_the_sums_in_little_memory():
    rng = np.random.default_rng(3)
    parts = []
    for _ in range(12):
        keys = np.unique(rng.integers(0, 2**40, 200_000, dtype=np.uint64))
        keys[:3] = [1, 2, 3]
        parts.append((keys, rng.integers(1, 9, len(keys)).astype("u4")))
    wanted = {}
    for k in (1, 2, 3):
        wanted[k] = sum(int(v[list(keys[:3]).index(k)]) for keys, v in parts)
    tracemalloc.start()
    n, total, last = 0, 0, -1
    for keys, values in lm_score.merge_parts(parts):
        assert int(keys[0]) > last and (keys[1:] > keys[:-1]).all()
        for k in (1, 2, 3):
            if last < 0:
                assert int(values[np.searchsorted(keys, k)]) == wanted[k]
        n, total, last = n + len(keys), total + int(values.sum()), int(keys[-1])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(np.unique(np.concatenate([k for k, _ in parts]))) and total == sum(int(v.sum()) for _, v in parts)
    assert peak < 20 * sum(len(k) for k, _ in parts)  # 48 bytes a key when all was merged at once


def test_distinct_counts():
    for n in (0, 1, 1000):
        keys = np.random.default_rng(n).integers(0, 50, n, dtype=np.uint64)
        wanted = np.unique(keys, return_counts=True)
        got = lm_score.count_distinct(keys.copy())
        assert (got[0] == wanted[0]).all() and (got[1] == wanted[1]).all()


HELD = """
import re
import numpy as np
from quern.llm.common import tidy
def run(batches):
    kept = [np.ones(n, np.uint8) for _ in range(40) for n in (5_000_000, 3_000_000, 100_000)]
    pins = [bytearray(2000) for _ in range(50)]  # small blocks behind them
    del kept
    yield pins
held = lambda: int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024
np.ones(40_000_000, np.uint8)  # glibc takes its threshold from freed blocks
before = held()
pins = list(tidy(run)([]))
print(held() - before)
"""


def test_a_worker_keeps_no_freed_memory():
    out = subprocess.run([sys.executable, "-c", HELD], capture_output=True, text=True, check=True, timeout=60).stdout
    assert float(out.split()[-1]) < 20


def test_arrays_are_mapped_where_the_folder_is_not_mounted(tmp_path, monkeypatch):
    from pyarrow import fs

    monkeypatch.setattr(common, "_filesystem", lambda uri: (fs.LocalFileSystem(), uri.removeprefix("store:/")))
    for n in (0, 1000):
        common.put_array(f"store:/{tmp_path}/a", np.arange(n, dtype="u8"))
        got = common.map_array(f"store:/{tmp_path}/a", "u8")
        assert (got == np.arange(n)).all() and (n == 0 or isinstance(got, np.memmap))


def test_workers_of_the_pipeline_give_back_and_get_little_at_a_time(spark, monkeypatch):
    from pyspark.sql import functions as F

    from quern.llm import near_dedup, packing, toxicity

    docs = spark.createDataFrame([(i, "a b c " * 20_000) for i in range(20)], "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    run, names = type(docs).mapInArrow, []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, *a, **k: (names.append(f.__name__), run(self, f, *a, **k))[1])
    toxicity.score_toxicity(docs, labels)
    near_dedup._describe(docs, F.col("text"), "doc_id")
    packing.tokenize_pieces(docs)
    assert names == ["tidied"] * 3

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    got = [r["n"] for r in common.cut(docs.select("text").mapInArrow(sizes, "n long"), 1 << 19).collect()]
    assert len(got) > 3 and max(got) < 1 << 20 and spark.conf.get(setting) == before
