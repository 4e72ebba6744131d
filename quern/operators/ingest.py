"""Writes into documents, graphs, KV collections and evidence, single or as whole batches.

A batch form splits its candidates into accepted and rejected rows by joins; the single forms
check one request and append a row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.errors import WRITE_CODES, EngineError
from quern.functions.cells import CELL, FIELDS, cell_value, first_wins
from quern.functions.evidence import MAX_PAYLOAD, digest_hex, rejection
from quern.plans import request as rq
from quern.sources.catalog import EVIDENCE, EVIDENCE_SCHEMA, Catalog, Documents, Evidence, Graph, Kv

DOCUMENT = T.StructType([T.StructField("id", T.StringType()), T.StructField("fields", FIELDS), T.StructField("_row_seq", T.LongType())])
EDGE = T.StructType([T.StructField(n, T.StringType()) for n in ("source", "label", "target")] + [T.StructField("_row_seq", T.LongType())])
PUT = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", CELL), T.StructField("_row_seq", T.LongType())])
PAYLOAD = T.StructType([T.StructField("evidence_id", T.LongType()), T.StructField("payload", T.BinaryType())])

# fixed values: bounds of evidence
MAX_STAGES, MAX_STAGED_BYTES, MAX_RETAINED_BYTES = 8, 64 << 20, 512 << 20


def split_documents(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """candidates (id, fields, _row_seq) with `rejected`: null, EmptyId or DuplicateId.

    Of new documents with one id the first is taken, as if they came one after the other.
    """
    first = candidates.groupBy("id").agg(F.min("_row_seq").alias("_first"))
    known = existing.select("id", F.lit(True).alias("_known"))
    reason = F.when(F.coalesce(F.col("id"), F.lit("")) == "", "EmptyId").when(F.col("_known") | (F.col("_row_seq") != F.col("_first")), "DuplicateId")
    return candidates.join(first, "id", "left").join(known, "id", "left").withColumn("rejected", reason).drop("_first", "_known")


def split_edges(candidates: DataFrame, nodes: DataFrame, existing: DataFrame) -> DataFrame:
    """candidates (source, label, target, _row_seq) with `rejected`: null, NodeNotFound or DuplicateEdge."""
    triple = ["source", "label", "target"]
    ids = nodes.select("id").distinct()
    ends = candidates.join(ids.select(F.col("id").alias("source"), F.lit(True).alias("_near")), "source", "left").join(
        ids.select(F.col("id").alias("target"), F.lit(True).alias("_far")), "target", "left"
    )
    first = candidates.groupBy(*triple).agg(F.min("_row_seq").alias("_first"))
    known = existing.select(*triple, F.lit(True).alias("_known")).distinct()
    reason = F.when(F.col("_near").isNull() | F.col("_far").isNull(), "NodeNotFound").when(F.col("_known") | (F.col("_row_seq") != F.col("_first")), "DuplicateEdge")
    return ends.join(first, triple).join(known, triple, "left").withColumn("rejected", reason).select(*triple, "_row_seq", "rejected")


#: Rows of a block of the order, in which the quota is followed row by row.
QUOTA_BLOCK = 4096


def accept_evidence(candidates: DataFrame, order: str, retained: int = 0, most: int = MAX_RETAINED_BYTES) -> DataFrame:
    """candidates (the metadata columns, payload_length) with `kept_bytes`, all that is kept after the row, and `rejected`.

    Rows come one after the other in the order, nulls last. One that would take the kept bytes
    beyond the quota is rejected and keeps nothing, so a later, smaller one may still fit; bad
    metadata is looked at after sizes and the quota. What fits is found by sums of blocks: all
    blocks before the first that overflows fit whole, that block's rows (QUOTA_BLOCK ids) are
    followed on the driver, and after it only rows count that are small enough for what is left.
    """
    place = F.coalesce(F.col(order).cast("long"), F.lit(2**63 - 1))
    block = F.floor(place / QUOTA_BLOCK)
    size = F.coalesce(F.col("payload_length"), F.lit(0)).cast("long")
    reason = rejection(*[F.col(c) for c in ("object_id", "media_type", "observed_at", "origin", "owner", "payload_length")])
    judged = candidates.withColumn("_reason", reason).withColumn("_size", size).withColumn("_place", place).withColumn("_block", block)
    valid = judged.where("_reason is null").select("_place", "_block", "_size")
    left, done = most - retained, F.lit(-(2**62))
    fits = F.lit(False)
    while True:
        rest = valid.where((F.col("_block") > done) & (F.col("_size") <= left))
        sums = rest.groupBy("_block").agg(F.sum("_size").alias("_sum"))
        running = sums.withColumn("_run", F.sum("_sum").over(Window.orderBy("_block")))
        full = running.where(F.col("_run") > left).orderBy("_block").select("_block", F.col("_run") - F.col("_sum")).first()
        if full is None:
            fits = fits | ((F.col("_block") > done) & (F.col("_size") <= left))
            break
        at, before = full
        fits = fits | ((F.col("_block") > done) & (F.col("_block") < at) & (F.col("_size") <= left))
        left, taken = left - before, []
        for own, n in rest.where(F.col("_block") == at).orderBy("_place").select("_place", "_size").collect():  # a block
            if n <= left:
                left, taken = left - n, [*taken, own]
        fits, done = fits | ((F.col("_block") == at) & F.col("_place").isin(taken)), F.lit(at)
    kept = F.when(F.col("_reason").isNull() & fits, F.col("_size")).otherwise(0)
    judged = judged.withColumn("_kept", kept)
    before = judged.groupBy("_block").agg(F.sum("_kept").alias("_sum"))
    before = before.select("_block", F.coalesce(F.sum("_sum").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = Window.partitionBy("_block").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    run = judged.join(before, "_block").withColumn("kept_bytes", F.col("_before") + F.sum("_kept").over(own) + retained)
    over = F.col("kept_bytes") - F.col("_kept") + F.col("_size") > most
    rejected = F.when(F.col("_size") > MAX_PAYLOAD, "PayloadTooLarge").when(over, "RetainedQuotaExceeded").otherwise(F.col("_reason"))
    return run.withColumn("rejected", rejected).drop("_block", "_place", "_before", "_reason", "_size", "_kept")


@dataclass
class Staging:
    """Admission of uploads before they become evidence."""

    active: int = 0
    bytes: int = 0
    rejections: int = 0
    aborted: int = 0

    def begin(self, length: int) -> None:
        if self.active >= MAX_STAGES or self.bytes + length > MAX_STAGED_BYTES:
            self.rejections += 1
            raise EngineError("StagingQuotaExceeded", code="EV1001")
        self.active, self.bytes = self.active + 1, self.bytes + length

    def finish(self, length: int) -> None:
        self.active, self.bytes = self.active - 1, self.bytes - length

    def abort(self, length: int) -> None:
        self.finish(length)
        self.aborted += 1


def _append(df: DataFrame, spark: SparkSession, row: tuple, schema: T.StructType) -> DataFrame:
    return df.unionByName(spark.createDataFrame([row], schema))


def _next(df: DataFrame) -> int:
    return (df.agg(F.max("_row_seq")).first()[0] or 0) + 1


def _of_kind(catalog: Catalog, name: str, kind: type, empty) -> object:
    if name not in catalog.sources:
        catalog.add(name, empty())
    source = catalog.sources[name]
    if not isinstance(source, kind):
        raise EngineError("TableExists", name)
    return source


def _document(df: DataFrame, spark: SparkSession, id_: str, fields: tuple, code: str) -> DataFrame:
    if df.where(F.col("id") == id_).limit(1).count():
        raise EngineError("DuplicateId", id_, code)
    cells = {k: cell_value(v) for k, v in first_wins(fields).items()}
    return _append(df, spark, (id_, cells, _next(df)), DOCUMENT)


def apply(spark: SparkSession, catalog: Catalog, request: rq.Request, payload: bytes | None = None, owner: str = "development", algorithm: str = "sha2-256") -> dict:
    """One write request: its result row, or EngineError with the request's code. Collections come into being."""
    rq.validate(request)
    make = lambda schema: spark.createDataFrame([], schema)
    match request:
        case rq.InsertDocument():
            code = WRITE_CODES["document_insert"]
            docs = _of_kind(catalog, request.collection, Documents, lambda: Documents(make(DOCUMENT)))
            catalog.replace(request.collection, Documents(_document(docs.df, spark, request.id, request.fields, code)))
            return {"document_id": request.id}
        case rq.AddNode():
            graph = _of_kind(catalog, request.graph, Graph, lambda: Graph(make(DOCUMENT), make(EDGE)))
            catalog.replace(request.graph, Graph(_document(graph.nodes, spark, request.id, request.fields, WRITE_CODES["graph_add_node"]), graph.edges))
            return {"node_id": request.id}
        case rq.AddEdge():
            code = WRITE_CODES["graph_add_edge"]
            graph = catalog.sources.get(request.graph)
            if not isinstance(graph, Graph):
                raise EngineError("GraphNotFound", request.graph, code)
            one = spark.createDataFrame([(request.source, request.label, request.target, _next(graph.edges))], EDGE)
            reason = split_edges(one, graph.nodes, graph.edges).first()["rejected"]
            if reason:
                raise EngineError(reason, f"{request.source} {request.label} {request.target}", code)
            catalog.replace(request.graph, Graph(graph.nodes, graph.edges.unionByName(one)))
            return {"from": request.source, "label": request.label, "to": request.target}
        case rq.PutKv():
            kv = _of_kind(catalog, request.collection, Kv, lambda: Kv(make(PUT)))
            catalog.replace(request.collection, Kv(_append(kv.log, spark, (request.key, cell_value(request.item), _next(kv.log)), PUT)))
            return {"key": request.key, "value": request.item}
        case rq.Observe():
            return _observe(spark, catalog, request, payload or b"", owner, algorithm)
        case rq.ReadPayload():
            return {"payload": read_payload(catalog, request.evidence_id, algorithm)}
    raise EngineError("InvalidOperation", type(request).__name__)


def _observe(spark: SparkSession, catalog: Catalog, request: rq.Observe, payload: bytes, owner: str, algorithm: str) -> dict:
    code = WRITE_CODES["observe"]
    if EVIDENCE not in catalog.sources:
        catalog.add(EVIDENCE, Evidence(spark.createDataFrame([], EVIDENCE_SCHEMA), spark.createDataFrame([], PAYLOAD)))
    known = catalog.sources[EVIDENCE]
    last, kept = known.df.agg(F.coalesce(F.max("evidence_id"), F.lit(0)), F.coalesce(F.sum("payload_length"), F.lit(0))).first()
    if len(payload) > MAX_PAYLOAD or kept + len(payload) > MAX_RETAINED_BYTES:
        raise EngineError("PayloadTooLarge" if len(payload) > MAX_PAYLOAD else "RetainedQuotaExceeded", code=code)
    row = (last + 1, request.object_id, rq.MODALITIES[request.modality], request.media_type, request.observed_at, request.origin, owner, len(payload), None)
    held = spark.createDataFrame([(last + 1, bytearray(payload))], PAYLOAD)
    one = spark.createDataFrame([row], EVIDENCE_SCHEMA).drop("payload_digest").join(held.select("evidence_id", digest_hex(F.col("payload"), algorithm).alias("payload_digest")), "evidence_id")
    reason = accept_evidence(one, "evidence_id", kept).first()["rejected"]
    if reason:
        raise EngineError(reason, request.object_id, code)
    catalog.replace(EVIDENCE, Evidence(known.df.unionByName(one), known.payloads.unionByName(held)))
    return {"evidence_id": last + 1}


def read_payload(catalog: Catalog, evidence_id: int, algorithm: str = "sha2-256") -> bytes:
    """A payload, checked against its recorded length and digest."""
    code = WRITE_CODES["read_evidence_payload"]
    known = catalog.sources.get(EVIDENCE)
    if known is None:
        raise EngineError("EvidenceNotFound", str(evidence_id), code)
    meta = known.df.where(F.col("evidence_id") == evidence_id).select("evidence_id", "payload_length", "payload_digest")
    found = meta.join(known.payloads, "evidence_id").withColumn("_digest", digest_hex(F.col("payload"), algorithm)).first()
    if found is None:
        raise EngineError("EvidenceNotFound", str(evidence_id), code)
    if len(found["payload"]) != found["payload_length"] or found["_digest"] != found["payload_digest"]:
        raise EngineError("CorruptEvidence", str(evidence_id), code)
    return bytes(found["payload"])
