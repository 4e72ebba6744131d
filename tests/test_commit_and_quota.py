"""Unique columns at commit, the evidence quota row by row, failed publications."""

import random

import pytest
from pyspark.sql import functions as F

from quern.errors import EngineError
from quern.operators import ingest
from quern.operators.database import Column, Database
from quern.operators.store import Store
from quern.streaming.batches import batch_plan


@pytest.fixture
def db(spark):
    db = Database(spark)
    db.create_table("t", [Column("id", "int", primary_key=True), Column("tag", "text", unique=True)])
    return db


def tags(db):
    return sorted((r["id"], r["tag"]) for r in db.read("t").collect())


def test_the_second_of_two_transactions_loses_a_unique_value(db):
    one, two = db.begin(), db.begin()
    db.stage_insert(one, "t", {"id": 1, "tag": "x"})
    db.stage_insert(two, "t", {"id": 2, "tag": "x"})
    db.commit(one)
    with pytest.raises(EngineError, match="UniqueViolation"):
        db.commit(two)
    assert two.state == "failed" and tags(db) == [(1, "x")] and db.published == 1
    db.rollback(two)


def test_values_may_move_within_a_transaction(db):
    db.insert("t", {"id": 1, "tag": "x"})
    db.insert("t", {"id": 2, "tag": None})
    tx = db.begin()
    db.stage_update(tx, "t", 1, {"id": 1, "tag": "y"})
    db.stage_insert(tx, "t", {"id": 3, "tag": "x"})
    db.stage_insert(tx, "t", {"id": 4, "tag": None})
    db.commit(tx)
    assert tags(db) == [(1, "y"), (2, None), (3, "x"), (4, None)]
    late = db.begin()
    db.stage_update(late, "t", 2, {"id": 2, "tag": "z"})
    db.update("t", 1, {"id": 1, "tag": "z"})
    with pytest.raises(EngineError, match="UniqueViolation"):
        db.commit(late)


def test_unique_columns_of_a_heap(spark):
    db = Database(spark)
    db.create_table("h", [Column("v", "text", unique=True)])
    one, two = db.begin(), db.begin()
    for tx in (one, two):
        db.stage_insert(tx, "h", {"v": "a"})
    db.commit(one)
    with pytest.raises(EngineError, match="UniqueViolation"):
        db.commit(two)
    assert db.read("h").count() == 1


def offered(spark, rows):
    df = spark.createDataFrame(rows, "n long, payload_length long, media_type string")
    return df.select("*", *[F.lit(v).alias(k) for k, v in (("object_id", "o"), ("observed_at", "2026Z"), ("origin", "lab"), ("owner", "me"))])


def test_a_later_smaller_payload_still_fits(spark):
    got = {r["n"]: (r["kept_bytes"], r["rejected"]) for r in ingest.accept_evidence(offered(spark, [(1, 900, "a/b"), (2, 200, "a/b"), (3, 50, "a/b"), (4, 60, "A/B"), (5, 50, "A/B"), (None, 50, "a/b")]), "n", most=1000).collect()}
    over = "RetainedQuotaExceeded"
    assert got == {1: (900, None), 2: (900, over), 3: (950, None), 4: (950, over), 5: (950, "InvalidMediaType"), None: (1000, None)}
    assert ingest.accept_evidence(offered(spark, []), "n").count() == 0


def test_the_quota_equals_one_row_after_the_other(spark, monkeypatch):
    monkeypatch.setattr(ingest, "QUOTA_BLOCK", 7)
    rng = random.Random(4)
    for most in (0, 300, 2000, 10**6):
        rows = [(n, rng.choice([0, 1, 5, 40, 300, 900]), rng.choice(["a/b", "a/b", "bad"])) for n in rng.sample(range(400), 150)]
        kept, want = 0, {}
        for n, size, media in sorted(rows):
            if kept + size > most:
                want[n] = (kept, "RetainedQuotaExceeded")
            elif media == "bad":
                want[n] = (kept, "InvalidMediaType")
            else:
                kept += size
                want[n] = (kept, None)
        got = {r["n"]: (r["kept_bytes"], r["rejected"]) for r in ingest.accept_evidence(offered(spark, rows), "n", most=most).collect()}
        assert got == want


def test_a_failed_publication_changes_nothing(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/s")
    store.flush("t", spark.createDataFrame([(1, "a")], "id long, v string"), "id")
    before = store.manifest

    def fail(manifest):
        raise OSError("no space")

    monkeypatch.setattr(store, "_publish", fail)
    for change in (lambda: store.flush("t", spark.createDataFrame([(2, "b")], "id long, v string"), "id"), lambda: store.compact("t"), lambda: store.next_serial("t")):
        with pytest.raises(OSError):
            change()
    monkeypatch.undo()
    assert store.manifest == before == Store(spark, f"file://{tmp_path}/s").manifest
    assert [r["id"] for r in store.scan("t").collect()] == [1] and len(store.orphans()) == 2 and store.reclaim_orphans() == 2


def test_batches_hold_rows_without_a_place(spark):
    df = spark.createDataFrame([(None,), (3,), (None,), (70_000,)], "n long")
    assert sorted((r["batch"], r["n"] or 0) for r in batch_plan(df, "n", rows=2).collect()) == [(0, 0), (0, 0), (1, 3), (1, 70_000)]
