"""The replay order of a whole log, over several blocks."""

from quern.operators.store import replay_order
from quern.queries import QUERIES


def test_every_record_has_its_place(spark):
    ids = [*range(0, 3000, 7), *range(150_000, 150_900), 10**12, None]
    log = spark.createDataFrame([(i,) for i in reversed(ids)], "event_id long")
    for width in (10, 65_536):
        got = sorted((r["pos"], r["event_id"]) for r in replay_order(log, "event_id", width).collect())
        assert got == list(enumerate(ids, 1))


def test_query_covers_the_log(spark, tmp_path):
    n = 70_000  # beyond one block, and beyond the first thousand
    spark.range(n, numPartitions=3).withColumnRenamed("id", "event_id").write.parquet(f"file://{tmp_path}/events.parquet")
    got = QUERIES["wal_replay_log"](spark, f"file://{tmp_path}")
    assert got.count() == n and got.where("pos <> event_id + 1").count() == 0
