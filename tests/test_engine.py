"""Scenarios over small tables: each collection, versions, transactions, ingest, files, batches."""

import re

import pytest
from pyspark.sql import functions as F

from quern.errors import BindError, Canceled, EngineError
from quern.functions.evidence import blake3, has_utc_offset, valid_media_type
from quern.functions.like import like
from quern.functions.vectors import top_k
from quern.operators.database import Column, Database
from quern.operators.ingest import Staging, read_payload
from quern.operators.store import Store, frame_checksum
from quern.operators.versions import SnapshotRegistry
from quern.plans import request as rq
from quern.plans.codec import encode
from quern.plans.parser import parse
from quern.session import Session
from quern.sources.catalog import Catalog, Documents, relation
from quern.streaming.batches import Metrics, drain, stream


@pytest.fixture(scope="module")
def people(spark):
    df = spark.createDataFrame([(4, "ute", None, True), (5, "max", "west", False), (6, "una", "west", True)], "id int, name string, region string, active boolean")
    return Session(spark, Catalog().add("customer", relation(df, F.col("id"), "id")))


@pytest.mark.parametrize(
    "where, ids",
    [
        ("id in (4, 6)", "46"), ("name not in ('ute')", "56"), ("region is null", "4"), ("region is not null", "56"), ("name like 'u%'", "46"), ("name not like 'u_a'", "45"),
        ("active = true", "46"), ("id != 5", "46"), ("region != 'south'", "56"), ("NAME = 'max'", "5"), ("name > 'max'", "46"), ("id <= 5", "45"), ("region not in ('south')", "56"),
    ],
)
def test_relation_operators(people, where, ids):
    source = f"from customer\n| where {where}\n| emit {{ id }}\n| limit 9"
    assert "".join(r[0] for r in people.execute(source)) == ids
    assert people.execute(encode(parse(source))) == people.execute(source)


@pytest.mark.parametrize(
    "source, kind",
    [
        ("from nobody\n| emit { id }", "SemanticNameNotFound"), ("from customer\n| emit { nope }", "FieldNotFound"), ("from customer\n| emit { ID }", "FieldNotFound"),
        ("from customer\n| where id = 'x'\n| emit { id }", "TypeMismatch"), ("from customer\n| where id like 'x'\n| emit { id }", "TypeMismatch"),
        ("from customer\n| where active > false\n| emit { id }", "NonComparableColumn"), ("from customer\n| navigate e as x\n| emit { id }", "UnsupportedNavigate"),
    ],
)
def test_bind_errors_come_before_any_job(people, source, kind):
    with pytest.raises(BindError) as e:
        people.frame(source)
    assert e.value.kind == kind and e.value.code == "RF1002"


def test_duplicate_columns_revision_and_tool(people):
    assert people.execute("from customer\n| emit { id, id }\n| limit 1") == [("4", "4")]
    with pytest.raises(BindError, match="ModelRevisionMismatch"):
        people.frame(rq.Emit("customer", ("id",), revision=1))
    assert people.tool({"source": "from customer\n| emit { name, active }\n| limit 1"})["structuredContent"] == {"columns": ["name", "active"], "rows": [["ute", "true"]]}
    assert people.tool({"source": "from x\n| emit { y }"})["isError"]


def byte_like(text: str, pattern: str) -> bool | None:
    """LIKE over bytes, written down plainly."""
    p, out, i = pattern.encode(), b"", 0
    while i < len(p):
        if p[i : i + 1] == b"\\":
            if i + 1 == len(p):
                return False
            out, i = out + re.escape(p[i + 1 : i + 2]), i + 2
            continue
        out, i = out + {b"%": b".*", b"_": b"."}.get(p[i : i + 1], re.escape(p[i : i + 1])), i + 1
    return re.fullmatch(out, text.encode(), re.DOTALL) is not None


def test_like_is_over_bytes(spark):
    texts = ["", "a", "ab", "aé", "é", "a%b", "a_b", "a\\b", "a\nb", "100%"]
    patterns = ["", "%", "a%", "_", "__", "a_", "a__", "%é", "a\\%b", "a\\_b", "a\\\\b", "a\\b", "a_b", "%\\", "a\\", "%0%"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", *[like(F.col("t"), p).alias(f"p{i}") for i, p in enumerate(patterns)]).collect()
    for row in got:
        assert [row[f"p{i}"] for i in range(len(patterns))] == [byte_like(row["t"], p) for p in patterns], row["t"]


def test_documents_graph_kv(spark):
    s = Session(spark)
    s.write(rq.InsertDocument("books", "1", (("title", "Dune"), ("author.name", "Herbert"), ("pages", 412), ("pages", 1))))
    assert s.write(encode(rq.InsertDocument("books", "2", (("title", "Snow Crash"), ("pages", 480))))) == {"document_id": "2"}
    assert s.execute("from books\n| where pages > 400\n| emit { title, author.name, author, pages }\n| limit 5") == [("Dune", "Herbert", None, "412"), ("Snow Crash", None, None, "480")]
    assert s.execute("from books\n| where pages = '412'\n| emit { title }") == []
    assert len(s.execute("from books\n| where pages not in ('x')\n| emit { title }")) == 2
    assert len(s.execute("from books\n| where pages not like 'x'\n| emit { title }")) == 2
    assert Session(spark, s.catalog, strict_types=True).execute("from books\n| where pages not in ('x')\n| emit { title }") == []
    with pytest.raises(EngineError) as e:
        s.write(rq.InsertDocument("books", "1"))
    assert (e.value.kind, e.value.code) == ("DuplicateId", "DF1001")
    for i, name in enumerate(("Ada", "Grace", "Lin"), 1):
        s.write(rq.AddNode("social", str(i), (("name", name),)))
    for a, label, b in (("1", "mentors", "2"), ("1", "mentors", "3"), ("2", "collaborates", "3")):
        s.write(rq.AddEdge("social", a, label, b))
    assert s.execute("from social\n| where name = 'Ada'\n| navigate mentors as m\n| emit { name, m.name }\n| limit 9") == [("Ada", "Grace"), ("Ada", "Lin")]
    assert s.execute("from social\n| navigate mentors as m\n| where m.name = 'Lin'\n| emit { name }") == []
    for a, b, kind in (("1", "9", "NodeNotFound"), ("1", "2", "DuplicateEdge")):
        with pytest.raises(EngineError) as e:
            s.write(rq.AddEdge("social", a, "mentors", b))
        assert (e.value.kind, e.value.code) == (kind, "GF1002")
    for key, value in (("theme", "dark"), ("retries", 3), ("beta", True), ("retries", 9)):
        s.write(rq.PutKv("settings", key, value))
    assert s.execute("from settings\n| emit { key, value, other }\n| limit 9") == [("theme", "dark", None), ("retries", "9", None), ("beta", "true", None)]
    assert s.execute("from settings\n| where key like 'r%'\n| emit { value }") == [("9",)]
    with pytest.raises(EngineError):
        s.write(rq.PutKv("books", "a", 1))


def test_evidence(spark):
    s = Session(spark)
    first = rq.Observe(1, "camera_1", 2, "image/png", "2026-08-01T10:00:00+02:00", "lab")
    assert s.write(first, b"first payload") == {"evidence_id": 1}
    assert s.write(rq.Observe(2, "camera_2", 3, "audio/ogg", "2026Z", "lab"), b"second payload") == {"evidence_id": 2}
    assert s.execute("from observation_evidence\n| where media_type = 'audio/ogg'\n| emit { evidence_id, object_id, payload_length }") == [("2", "camera_2", "14")]
    assert s.write(rq.ReadPayload(1))["payload"] == b"first payload" == read_payload(s.catalog, 1)
    for bad in (rq.Observe(3, "c", 1, "Image/png", "2026Z", "lab"), rq.Observe(3, "c", 1, "a/b", "2026-08-01T10:00:00", "lab"), rq.Observe(3, "c" * 1025, 1, "a/b", "2026Z", "lab")):
        with pytest.raises(EngineError):
            s.write(bad, b"x")
    with pytest.raises(EngineError):
        s.write(rq.ReadPayload(7))
    staging = Staging()
    for _ in range(8):
        staging.begin(1)
    with pytest.raises(EngineError):
        staging.begin(1)
    staging.abort(1)
    staging.begin(1)


def test_metadata_checks(spark):
    media = ["a/b", "a/", "/b", "ab", "a/B", "a/b c", "a/b+c", "a/b/c", "a" * 253 + "/b", "a" * 254 + "/b"]
    times = ["Z", "xZ", "T+", "2026-01-01T00:00:00", "2026-01-01T00:00:00-05", "2026-01-01", "x"]
    df = spark.createDataFrame([(m,) for m in media], "m string")
    assert [r[0] for r in df.select(valid_media_type(F.col("m"))).collect()] == [True, False, False, False, False, False, True, True, True, False]
    df = spark.createDataFrame([(t,) for t in times], "t string")
    assert [r[0] for r in df.select(has_utc_offset(F.col("t"))).collect()] == [False, True, True, False, True, False, False]


def test_blake3_published_digests():
    pattern = lambda n: bytes(i % 251 for i in range(n))
    assert blake3(b"") == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert blake3(b"abc") == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"
    assert blake3(pattern(1)) == "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213"
    assert blake3(pattern(1024)) == "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7"
    assert blake3(pattern(1025)) == "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444"
    assert len({blake3(pattern(n)) for n in (2048, 2049, 3072, 3073, 5000, 8193)}) == 6


def test_frame_checksum(spark):
    import zlib

    df = spark.createDataFrame([(bytearray(b"hello"),), (bytearray(),)], "p binary")
    got = [r[0] for r in df.select(frame_checksum(F.col("p"))).collect()]
    assert got == [zlib.crc32(len(p).to_bytes(4, "little") + p) for p in (b"hello", b"")]


@pytest.fixture
def db(spark):
    db = Database(spark)
    db.create_table("t", [Column("id", "int", primary_key=True), Column("v", "int"), Column("email", "text", unique=True)])
    return db


def values(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_versions_across_history(db):
    db.insert("t", {"id": 1, "v": 10, "email": None})
    db.update("t", 1, {"id": 1, "v": 11, "email": None})
    db.delete("t", 1)
    db.insert("t", {"id": 1, "v": 100, "email": None})
    assert [values(db.read("t", s), "v") for s in (0, 1, 2, 3, 4)] == [[], [(10,)], [(11,)], [], [(100,)]]
    assert drain(db.emit(parse("from t\n| emit { v }"), s=2)) == [("11",)]
    db.snapshots.register(2)
    assert db.retention("t") == {"live": 1, "retained": 2, "unreclaimable": 2, "reclaimed": 0}
    db.snapshots.unregister(2)
    assert db.retention("t")["reclaimed"] == 2 and db.retained("t").count() == 1


def test_transactions(db):
    db.insert("t", {"id": 1, "v": 1, "email": "a"})
    db.insert("t", {"id": 3, "v": 3, "email": "c"})
    tx = db.begin()
    db.stage_insert(tx, "t", {"id": 2, "v": 2, "email": "b"})
    db.stage_update(tx, "t", 1, {"id": 1, "v": 9, "email": "a"})
    db.stage_delete(tx, "t", 3)
    assert values(db.emit(parse("from t\n| emit { id, v }"), tx), "id", "v") == [(1, 9), (2, 2)]
    assert values(db.read("t"), "id", "v") == [(1, 1), (3, 3)]
    for stage in (lambda: db.stage_insert(tx, "t", {"id": 2, "v": 0, "email": None}), lambda: db.stage_insert(tx, "t", {"id": 7, "v": 0, "email": "b"}), lambda: db.stage_delete(tx, "t", 3), lambda: db.stage_update(tx, "t", 1, {"id": 5, "v": 0, "email": None})):
        with pytest.raises(EngineError):
            stage()
    other = db.begin()
    db.stage_update(other, "t", 1, {"id": 1, "v": 8, "email": "a"})
    db.commit(tx)
    assert values(db.read("t"), "id", "v") == [(1, 9), (2, 2)]
    with pytest.raises(EngineError, match="WriteWriteConflict"):
        db.commit(other)
    assert other.state == "failed" and values(db.read("t"), "v") == [(2,), (9,)]
    db.rollback(other)


def test_schema_changes(db):
    db.insert("t", {"id": 1, "v": 1, "email": None})
    db.add_column("t", Column("note", "text", default="new"))
    db.add_column("t", Column("at", "text", default="now"))
    assert values(db.read("t"), "note", "at") == [("new", None)]
    with pytest.raises(EngineError):
        db.set_not_null("t", "at")
    db.drop_column("t", "v")
    with pytest.raises(EngineError):
        db.drop_column("t", "id")
    with pytest.raises(EngineError):
        db.create_table("t", [Column("a", "int")])
    with pytest.raises(EngineError):
        db.create_table("u", [Column("a", "int", primary_key=True), Column("b", "int", primary_key=True)])
    with pytest.raises(EngineError):
        db.insert("t", {"id": None, "email": None, "note": "", "at": ""})
    assert db.next_serial("t") == 1 and db.next_serial("t") == 2


def test_heap_table(spark):
    db = Database(spark)
    db.create_table("events", [Column("payload", "text")])
    db.insert("events", {"payload": "a"})
    db.insert("events", {"payload": "a"})
    assert [r[0] for r in drain(db.emit(parse("from events\n| emit { payload }\n| limit 5")))] == ["a", "a"]


def test_snapshot_registry():
    r = SnapshotRegistry(2)
    r.register(3), r.register(3)
    with pytest.raises(EngineError):
        r.register(4)
    r.unregister(3)
    assert r.oldest(9) == 3
    r.unregister(3)
    assert r.oldest(9) == 10


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/db")
    for n in range(4):
        rows = spark.range(n, n + 3).selectExpr("id", f"id * 10 + {n} as v")
        store.flush("t", rows, "id")
    assert values(store.scan("t"), "id", "v") == [(3, 33), (4, 43), (5, 53)]
    assert store.lookup("t", 0).first()["_deleted"] and store.compaction_due() == ["t"]
    (tmp_path / "db" / "stray").mkdir()
    store.compact("t")
    assert store.entries("t").count() == 3 and not store.compaction_due()
    assert store.reclaim_orphans() == 5
    assert store.next_serial("t", 3) == 1
    again = Store(spark, f"file://{tmp_path}/db")
    assert values(again.scan("t"), "v") == [(33,), (43,), (53,)] and again.next_serial("t") == 4
    path = tmp_path / "db" / "MANIFEST.json"
    path.write_text(path.read_text().replace("published", "publishee"))
    (tmp_path / "db" / ".MANIFEST.json.crc").unlink(missing_ok=True)
    with pytest.raises(EngineError, match="CorruptManifest"):
        Store(spark, f"file://{tmp_path}/db")


def test_vectors(spark):
    df = spark.createDataFrame([(2, [0.0, 1.0]), (1, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None)], "i long, e array<float>")
    for metric in ("dot", "cosine", "l2"):
        assert [r["i"] for r in top_k(df, "e", [0.0, 1.0], metric, 2, "i").orderBy("rk").collect()] == [2, 3]
    assert top_k(df, "e", [0.0, 0.0], "cosine", 1, "i").first()["score"] == 0
    with pytest.raises(EngineError):
        top_k(df, "e", [0.0, 1.0], "dot", 0)
    with pytest.raises(Exception, match="InvalidVector"):
        top_k(df, "e", [0.0, 1.0, 2.0], "dot", 1, "i").collect()


def test_batches_and_cancel(spark):
    items = spark.range(0, 10, 1, 2).toDF("id")
    m = Metrics()
    assert [len(b) for b in stream(items, rows=3, metrics=m)] == [3, 3, 3, 1] and (m.batches, m.rows, m.largest_batch) == (4, 10, 3)
    docs = spark.range(6).selectExpr("repeat('x', 10) as p")
    assert [len(b) for b in stream(docs, size=25)] == [3, 3] and [len(b) for b in stream(docs, size=5)] == [1] * 6
    seen, asked = [], iter(range(100))
    with pytest.raises(Canceled):
        for b in stream(items, rows=1, canceled=lambda: next(asked) >= 7):
            seen += b
    assert len(seen) == 6
    s = Session(spark, Catalog().add("items", relation(items, F.col("id"))))
    rows = s.stream("from items\n| emit { id }", rows=2)
    next(rows)
    assert s.cancel() and not s.registry.cancel("no such credential")
    with pytest.raises(Canceled):
        list(rows)
    assert len(s.execute("from items\n| emit { id }")) == 10


def test_catalog_names_are_exclusive(spark):
    df = spark.range(1).toDF("id")
    catalog = Catalog().add("a", relation(df, F.col("id")))
    with pytest.raises(EngineError):
        catalog.add("a", Documents(df))
    with pytest.raises(EngineError):
        catalog.add("observation_evidence", Documents(df))
