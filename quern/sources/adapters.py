"""The driver's Parquet tables in the shapes of the engine's collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.cells import cell
from quern.functions.evidence import digest_hex
from quern.operators.versions import close_intervals

from .catalog import EVIDENCE, Catalog, Documents, Evidence, Graph, Kv, Part, Relation, Side, relation, widen

KEYS = {"customer": "c_custkey", "part": "p_partkey", "orders": "o_orderkey", "supplier": "s_suppkey", "nation": "n_nationkey", "region": "r_regionkey"}
OBSERVED_AT = "2026-01-01T00:00:00+00:00"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return widen(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def relations(spark: SparkSession, sf_dir: str, *names: str) -> Catalog:
    catalog = Catalog()
    for n in names:
        catalog.add(n, relation(load(spark, sf_dir, n), F.col(KEYS[n]), KEYS[n]))
    return catalog


def labelled(spark: SparkSession, sf_dir: str) -> Catalog:
    """documents with their labels, as a relation whose labels may be null."""
    both = load(spark, sf_dir, "documents").drop("text").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    return Catalog().add("labelled", relation(both, F.col("doc_id"), "doc_id"))


def documents(spark: SparkSession, sf_dir: str) -> Catalog:
    """docs: meta.lang, meta.source, n_chars, quality, toxic; absent where a document has no label."""
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("_row_seq"), "doc_id", "lang", "source", "n_chars")
    labels = Side(load(spark, sf_dir, "labels"), "doc_id", {n: ("int", n) for n in ("quality", "toxic")})
    return Catalog().add("docs", Documents(parts=(Part(docs, {"meta.lang": ("text", "lang"), "meta.source": ("text", "source"), "n_chars": ("int", "n_chars")}, (labels,)),)))


def _nodes(df: DataFrame, prefix: str, key: str, texts: dict[str, str], after: int) -> Part:
    """Nodes named by a prefix and a key, with text fields by column."""
    rows = df.select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), (F.col(key) + after).alias("_row_seq"), *texts.values())
    return Part(rows, {path: ("text", column) for path, column in texts.items()})


def sales(spark: SparkSession, sf_dir: str) -> Catalog:
    """Customers and their orders; customers come first."""
    customer, orders = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders")
    nodes = (
        _nodes(customer, "c", "c_custkey", {"name": "c_name", "segment": "c_mktsegment"}, 0),
        _nodes(orders, "o", "o_orderkey", {"status": "o_orderstatus", "priority": "o_orderpriority"}, 1 << 40),
    )
    edges = orders.select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source"), F.lit("placed").alias("label"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("target"), F.col("o_orderkey").alias("_row_seq")
    )
    return Catalog().add("sales", Graph(None, edges, nodes))


def places(spark: SparkSession, sf_dir: str) -> Catalog:
    """Nations in regions, suppliers and customers in nations."""
    tables = {n: load(spark, sf_dir, n) for n in ("region", "nation", "supplier", "customer")}
    short = {"region": ("r", "r_regionkey", "r_name"), "nation": ("n", "n_nationkey", "n_name"), "supplier": ("s", "s_suppkey", "s_name"), "customer": ("c", "c_custkey", "c_name")}
    nodes = tuple(_nodes(tables[name], letter, key, {"name": label}, k << 40) for k, (name, (letter, key, label)) in enumerate(short.items()))
    edges = None
    for k, (name, link, edge, target) in enumerate((("nation", "n_regionkey", "in_region", "r"), ("supplier", "s_nationkey", "in_nation", "n"), ("customer", "c_nationkey", "in_nation", "n"))):
        letter, key, _ = short[name]
        own = tables[name].select(
            F.concat(F.lit(letter), F.col(key).cast("string")).alias("source"), F.lit(edge).alias("label"), F.concat(F.lit(target), F.col(link).cast("string")).alias("target"), (F.col(key) + (k << 40)).alias("_row_seq")
        )
        edges = own if edges is None else edges.unionByName(own)
    return Catalog().add("places", Graph(None, edges, nodes))


def part_sizes(spark: SparkSession, sf_dir: str) -> Catalog:
    """p_name to p_size, put in the order of p_partkey."""
    part = load(spark, sf_dir, "part")
    return Catalog().add("partsize", Kv(part.select(F.col("p_name").alias("key"), cell("int", F.col("p_size")).alias("value"), F.col("p_partkey").alias("_row_seq"))))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as evidence, in the order of page_id; payload is the page's bytes."""
    return load(spark, sf_dir, "pages").select(
        (F.col("page_id") + 1).alias("evidence_id"), F.concat(F.lit("page_"), F.col("page_id").cast("string")).alias("object_id"), F.lit("text").alias("modality"), F.lit("text/html").alias("media_type"),
        F.lit(OBSERVED_AT).alias("observed_at"), F.col("url").alias("origin"), F.lit("development").alias("owner"), F.octet_length("html").cast("bigint").alias("payload_length"), F.col("html").cast("binary").alias("payload"),
    )


def evidence(spark: SparkSession, sf_dir: str, algorithm: str = "sha2-256") -> Catalog:
    seen = observations(spark, sf_dir)
    meta = seen.withColumn("payload_digest", digest_hex(F.col("payload"), algorithm)).drop("payload")
    return Catalog().add(EVIDENCE, Evidence(meta, seen.select("evidence_id", "payload")))


def user_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last event: an event replaces the one before, an error deletes the row."""
    events = load(spark, sf_dir, "events").withColumn("_seq", F.col("event_id") + 1)
    return close_intervals(events, "user_id", "_seq", F.col("event_type") == "error")


def user_table(spark: SparkSession, sf_dir: str) -> Catalog:
    versions = user_versions(spark, sf_dir).withColumn("_row_seq", F.col("_created_seq"))
    return Catalog().add("users", Relation(versions, "user_id", versioned=True))


def flushes(spark: SparkSession, sf_dir: str, files: int = 4) -> DataFrame:
    """Entries of `files` flushes: in each, a user's last event; an error is a tombstone."""
    events = load(spark, sf_dir, "events").withColumn("_seq", F.col("event_id") % files)
    last = events.groupBy("_seq", "user_id").agg(F.max_by(F.struct("event_id", "event_type"), "event_id").alias("r")).select("user_id", "_seq", "r.*")
    return last.withColumn("_deleted", F.col("event_type") == "error")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").withColumn("_row_seq", F.col("vec_id"))


