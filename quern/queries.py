"""Queries over the driver's tables that exercise the engine, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.cells import CELL, MEMBER, render_text
from quern.functions.evidence import digest_hex
from quern.functions.vectors import search, top_k
from quern.operators import txn, versions
from quern.operators.ingest import accept_evidence, split_documents, split_edges
from quern.operators.store import compact, newest, replay_order
from quern.plans.codec import decode, encode
from quern.plans.compile import bind
from quern.plans.parser import parse
from quern.sources import adapters as A
from quern.sources.catalog import Catalog
from quern.streaming.batches import batch_plan

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query and the SQL for its rows."""

    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def flow(name: str, catalog, source: str, sql: str, kinds: dict[str, str] | None = None, snapshot: int | None = None, strict_types: bool = False) -> None:
    """A query in the engine's language. kinds: result names of cells and their types, in order."""

    def shown(name: str, kind: str):
        if kind == "shown":
            return render_text(F.col(name), CELL).alias(name)
        return F.col(name)[MEMBER[kind]].alias(name) if kind in MEMBER else F.col(name)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        request = decode(encode(parse(source)))  # bytes say the same as text
        df = bind(request, catalog(spark, sf_dir), snapshot, strict_types)
        if kinds is None:
            return df
        return df.toDF(*kinds).select(*[shown(n, k) for n, k in kinds.items()])

    QUERIES[name], SQL[name] = run, sql


def _tables(*names: str):
    return lambda spark, sf_dir: A.relations(spark, sf_dir, *names)


CUSTOMER, PART, ORDERS = _tables("customer"), _tables("part"), _tables("orders")
KEY = "select c_custkey::bigint as c_custkey from customer where "

# --- relations

flow("rel_minimum", CUSTOMER, "from customer\n| where c_mktsegment = 'MACHINERY'\n| where c_custkey >= 10\n| emit { c_custkey, c_name }\n| limit 20",
     "select c_custkey, c_name from customer where c_mktsegment = 'MACHINERY' and c_custkey >= 10 order by c_custkey limit 20")
flow("rel_project", CUSTOMER, "from customer\n| emit { c_name, c_custkey }", "select c_name, c_custkey from customer")
flow("rel_eq_text", CUSTOMER, "from customer\n| where c_mktsegment = 'MACHINERY'\n| emit { c_custkey }", KEY + "c_mktsegment = 'MACHINERY'")
flow("rel_neq", CUSTOMER, "from customer\n| where c_mktsegment != 'MACHINERY'\n| emit { c_custkey }", KEY + "c_mktsegment <> 'MACHINERY'")
flow("rel_range", CUSTOMER, "from customer\n| where c_custkey >= 100\n| where c_custkey < 200\n| emit { c_custkey }", KEY + "c_custkey >= 100 and c_custkey < 200")
flow("rel_le_gt", CUSTOMER, "from customer\n| where c_custkey > 10\n| where c_custkey <= 50\n| emit { c_custkey }", KEY + "c_custkey > 10 and c_custkey <= 50")
flow("rel_text_order", PART, "from part\n| where p_brand > 'Brand#2'\n| emit { p_partkey, p_brand }", "select p_partkey, p_brand from part where p_brand > 'Brand#2'")
flow("rel_in", CUSTOMER, "from customer\n| where c_nationkey in (1, 3, 5)\n| emit { c_custkey }", KEY + "c_nationkey in (1, 3, 5)")
flow("rel_not_in", CUSTOMER, "from customer\n| where c_nationkey not in (1, 3, 5)\n| emit { c_custkey }", KEY + "c_nationkey not in (1, 3, 5)")
flow("rel_like", PART, "from part\n| where p_name like 'red%'\n| emit { p_partkey, p_name }", "select p_partkey, p_name from part where p_name like 'red%'")
flow("rel_not_like", PART, "from part\n| where p_name not like 'red%'\n| emit { p_partkey, p_name }", "select p_partkey, p_name from part where p_name not like 'red%'")
flow("rel_like_byte", ORDERS, "from orders\n| where o_orderpriority like '_-H%'\n| emit { o_orderkey }", "select o_orderkey from orders where o_orderpriority like '_-H%'")
flow("rel_like_escape", CUSTOMER, r"from customer" "\n" r"| where c_name not like '%\_\%%'" "\n| emit { c_custkey }", KEY + r"c_name not like '%\_\%%' escape '\'")
flow("rel_null", A.labelled, "from labelled\n| where quality is null\n| emit { doc_id, lang }", "select d.doc_id, d.lang from documents d left join labels l using (doc_id) where l.quality is null")
flow("rel_not_null", A.labelled, "from labelled\n| where quality is not null\n| emit { doc_id, quality }", "select doc_id, l.quality::bigint as quality from documents d join labels l using (doc_id) where l.quality is not null")
flow("rel_case_where", CUSTOMER, "from customer\n| where C_CUSTKEY = 7\n| emit { c_custkey }", KEY + "c_custkey = 7")
flow("rel_limit", CUSTOMER, "from customer\n| emit { c_custkey }\n| limit 10", "select c_custkey from customer order by c_custkey limit 10")
flow("rel_limit0", CUSTOMER, "from customer\n| emit { c_custkey }\n| limit 0", KEY + "false")


@query("rel_or_groups", KEY + "(c_nationkey = 3 and c_custkey < 100) or c_mktsegment = 'BUILDING'")
def _or_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bound form alone has OR: groups of ANDed tests."""
    from quern.functions.predicates import any_of, typed
    from quern.plans.request import Predicate as P

    groups = [[P("c_nationkey", "eq", 3), P("c_custkey", "lt", 100)], [P("c_mktsegment", "eq", "BUILDING")]]
    return A.load(spark, sf_dir, "customer").where(any_of([[typed(p, F.col(p.path)) for p in g] for g in groups])).select("c_custkey")


@query("rel_row_positions", "select c_custkey::bigint as pos from customer where c_mktsegment = 'MACHINERY' and c_nationkey = 3")
def _row_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind(parse("from customer\n| where c_mktsegment = 'MACHINERY'\n| where c_nationkey = 3\n| emit { c_custkey }"), CUSTOMER(spark, sf_dir)).toDF("pos")


# --- documents

DOCS = "documents d left join labels l using (doc_id)"
flow("doc_paths", A.documents, "from docs\n| emit { meta.lang, meta.source, quality }", f"select lang, source, l.quality::varchar as quality from {DOCS}", {"lang": "text", "source": "text", "quality": "shown"})
flow("doc_where_path", A.documents, "from docs\n| where meta.lang = 'fr'\n| where n_chars >= 1000\n| emit { meta.source, n_chars }", "select source, n_chars from documents where lang = 'fr' and n_chars >= 1000", {"source": "text", "n_chars": "int"})
flow("doc_absent_path", A.documents, "from docs\n| where meta is null\n| where quality is null\n| emit { meta, n_chars }", f"select null::varchar as meta, n_chars from {DOCS} where l.quality is null", {"meta": "text", "n_chars": "int"})
flow("doc_type_mismatch", A.documents, "from docs\n| where n_chars = '416'\n| emit { n_chars }", "select n_chars from documents where false", {"n_chars": "int"})
flow("doc_not_in_mismatch", A.documents, "from docs\n| where n_chars not in ('x')\n| emit { n_chars }", "select n_chars from documents where n_chars is not null", {"n_chars": "int"})
flow("doc_not_in_strict", A.documents, "from docs\n| where n_chars not in ('x')\n| emit { n_chars }", "select n_chars from documents where false", {"n_chars": "int"}, strict_types=True)
flow("doc_like", A.documents, "from docs\n| where meta.source like 'src1%'\n| where meta.lang not like 'e%'\n| emit { meta.source, meta.lang }", "select source, lang from documents where source like 'src1%' and lang not like 'e%'", {"source": "text", "lang": "text"})


@query("doc_insert_batch", "select doc_id::varchar as id, case when doc_id % 3 = 0 then 'DuplicateId' when rn > 1 then 'DuplicateId' end as rejected from (select doc_id, row_number() over (partition by doc_id order by k) as rn from documents, (values (1), (2)) t(k))")
def _doc_insert_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document offered twice to a collection that has a third of them."""
    docs = A.documents(spark, sf_dir).find("docs").df
    twice = docs.withColumn("_row_seq", F.col("_row_seq") * 2).unionByName(docs.withColumn("_row_seq", F.col("_row_seq") * 2 + 1))
    return split_documents(twice, docs.where(F.col("_row_seq") % 3 == 0)).select("id", "rejected")


# --- graphs

SALES = "customer c join orders o on o.o_custkey = c.c_custkey"
flow("graph_nodes", A.sales, "from sales\n| where status = 'F'\n| emit { status, priority, name }", "select o_orderstatus as status, o_orderpriority as priority, null::varchar as name from orders where o_orderstatus = 'F'", {"status": "text", "priority": "text", "name": "text"})
flow("graph_navigate", A.sales, "from sales\n| where segment = 'MACHINERY'\n| navigate placed as o\n| emit { name, o.status }", f"select c_name as name, o_orderstatus as status from {SALES} where c_mktsegment = 'MACHINERY'", {"name": "text", "status": "text"})
flow("graph_navigate_limit", A.sales, "from sales\n| where segment = 'MACHINERY'\n| navigate placed as o\n| emit { name, o.priority }\n| limit 20", f"select c_name as name, o_orderpriority as priority from {SALES} where c_mktsegment = 'MACHINERY' order by c_custkey, o_orderkey limit 20", {"name": "text", "priority": "text"})
flow("graph_navigate_alias_where", A.sales, "from sales\n| where o.status = 'F'\n| navigate placed as o\n| emit { name }", "select c_name as name from customer where false", {"name": "text"})
flow("graph_places", A.places, "from places\n| navigate in_region as r\n| emit { name, r.name }", "select n_name as nation, r_name as region from nation join region on n_regionkey = r_regionkey", {"nation": "text", "region": "text"})


@query("graph_edge_check", "select source, target, case when target like 'n9__' then 'NodeNotFound' when k > 1 then 'DuplicateEdge' end as rejected from (select 's' || s_suppkey as source, 'n' || case when s_suppkey % 7 = 0 then 900 + s_nationkey else s_nationkey end as target, k from supplier, (values (1), (2)) t(k))")
def _graph_edge_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier's edge twice; a seventh point at nations that don't exist."""
    s = A.load(spark, sf_dir, "supplier")
    target = F.when(F.col("s_suppkey") % 7 == 0, F.col("s_nationkey") + 900).otherwise(F.col("s_nationkey"))
    one = s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("source"), F.lit("in_nation").alias("label"), F.concat(F.lit("n"), target.cast("string")).alias("target"), (F.col("s_suppkey") * 2).alias("_row_seq"))
    places = A.places(spark, sf_dir).find("places")
    return split_edges(one.unionByName(one.withColumn("_row_seq", F.col("_row_seq") + 1)), places.nodes, places.edges.where("label = 'in_region'")).select("source", "target", "rejected")


# --- key-value collections

flow("kv_latest", A.part_sizes, "from partsize\n| emit { key, value }", "select p_name as key, arg_max(p_size, p_partkey)::bigint as value from part group by p_name", {"key": "plain", "value": "int"})
flow("kv_where_value", A.part_sizes, "from partsize\n| where value = 11\n| emit { key, value }", "select * from (select p_name as key, arg_max(p_size, p_partkey)::bigint as value from part group by p_name) where value = 11", {"key": "plain", "value": "int"})
flow("kv_first_put_order", A.part_sizes, "from partsize\n| emit { key, other }\n| limit 5", "select p_name as key, null::varchar as other from part group by p_name order by min(p_partkey) limit 5", {"key": "plain", "other": "text"})

# --- evidence

flow("ev_view", A.evidence, "from observation_evidence\n| where payload_length >= 5000\n| emit { evidence_id, object_id, modality, media_type, observed_at, origin, owner, payload_length }",
     f"select page_id + 1 as evidence_id, 'page_' || page_id as object_id, 'text' as modality, 'text/html' as media_type, '{A.OBSERVED_AT}' as observed_at, url as origin, 'development' as owner, strlen(html)::bigint as payload_length from pages where strlen(html) >= 5000")


@query("ev_digest", "select page_id + 1 as evidence_id, sha256(html) as payload_digest from pages")
def _ev_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind(parse("from observation_evidence\n| emit { evidence_id, payload_digest }"), A.evidence(spark, sf_dir))


@query("ev_digest_blake3")
def _ev_digest_blake3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows only: SQL has no BLAKE3; tested against published digests."""
    return A.observations(spark, sf_dir).select("evidence_id", digest_hex(F.col("payload"), "blake3").alias("payload_digest"))


@query("ev_observe_accept", """
with recursive c as (select page_id, row_number() over (order by page_id) as n, case when page_id % 10 = 3 then 'Text/HTML' else 'text/html' end as media, case when page_id % 10 = 7 then '2026-01-01 00:00:00' else '2026-01-01T00:00:00Z' end as seen, strlen(html)::bigint as size from pages),
j as (select *, case when media <> lower(media) then 'InvalidMediaType' when seen not like '%Z' then 'InvalidObservationTime' end as bad from c),
r as (select 0::bigint as n, 0::bigint as was, 0::bigint as kept union all select j.n, r.kept, case when bad is null and r.kept + size <= 500000 then r.kept + size else r.kept end from r join j on j.n = r.n + 1)
select page_id + 1 as evidence_id, kept as kept_bytes, case when was + size > 500000 then 'RetainedQuotaExceeded' else bad end as rejected from j join r using (n)""")
def _ev_observe_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages offered as evidence, some with bad metadata, under a quota of half a megabyte."""
    page = (F.col("evidence_id") - 1) % 10
    offered = A.observations(spark, sf_dir).drop("payload").withColumn("media_type", F.when(page == 3, "Text/HTML").otherwise("text/html"))
    offered = offered.withColumn("observed_at", F.when(page == 7, "2026-01-01 00:00:00").otherwise("2026-01-01T00:00:00Z"))
    return accept_evidence(offered, "evidence_id", most=500_000).select("evidence_id", F.col("kept_bytes").cast("bigint").alias("kept_bytes"), "rejected")


# --- versions

VERSIONS = "(select event_id, user_id, event_type, event_id + 1 as created, lead(event_id + 1) over (partition by user_id order by event_id) as deleted from events)"
SEEN = f"select user_id, event_id from {VERSIONS} where event_type <> 'error' and created <= {{s}} and (deleted is null or {{s}} < deleted)"

flow("mvcc_snapshot", A.user_table, "from users\n| emit { user_id, event_id }", SEEN.format(s=5000), snapshot=5000)
flow("mvcc_live", A.user_table, "from users\n| where event_type = 'click'\n| emit { user_id, event_id }", f"select user_id, event_id from {VERSIONS} where event_type = 'click' and deleted is null")


@query("mvcc_point", " union all ".join(f"select {s}::bigint as s, user_id, event_id from ({SEEN.format(s=s)}) where user_id = 3" for s in (100, 2000, 9000)))
def _mvcc_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key at three moments."""
    users = A.user_versions(spark, sf_dir)
    found = [versions.point_read(users, "user_id", 3, s).select(F.lit(s).cast("bigint").alias("s"), "user_id", "event_id") for s in (100, 2000, 9000)]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("mvcc_retained_newest", f"select user_id, max(event_id) as event_id from ({SEEN.format(s=5000)} and deleted is not null) group by user_id")
def _mvcc_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.newest_retained(A.user_versions(spark, sf_dir), "user_id", 5000).select("user_id", "event_id")


@query("mvcc_reclaim", f"select count(*) filter (deleted is null) as live, count(*) filter (deleted is not null) as retained, count(*) filter (deleted >= 5000) as unreclaimable, count(*) filter (deleted < 5000) as reclaimed from {VERSIONS} where event_type <> 'error'")
def _mvcc_reclaim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.retention_stats(A.user_versions(spark, sf_dir), 5000)


@query("mvcc_after_reclaim", f"select user_id, event_id from {VERSIONS} where event_type <> 'error' and (deleted is null or deleted >= 5000)")
def _mvcc_after_reclaim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.reclaim(A.user_versions(spark, sf_dir), 5000).select("user_id", "event_id")


# --- transactions


def _staged_orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """orders, and writes staged by key: 0 deleted, 1 updated, 2 deleted and put again, 3 a new key beside."""
    orders = A.load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    n, k = F.col("o_orderkey") % 10, F.col("o_orderkey")
    step = lambda rows, op, no, status: rows.withColumn("o_orderstatus", F.lit(status) if status else F.col("o_orderstatus")).withColumn("_op", F.lit(op)).withColumn("_op_no", k * 2 + no)
    staged = step(orders.where(n == 0), "delete", 0, None).unionByName(step(orders.where(n == 1), "update", 0, "U"))
    staged = staged.unionByName(step(orders.where(n == 2), "delete", 0, None)).unionByName(step(orders.where(n == 2), "insert", 1, "R"))
    fresh = orders.where(n == 3).withColumn("o_orderkey", k + 10_000_000_000)
    return orders, staged.unionByName(step(fresh, "insert", 0, "N"))


@query("tx_read_your_writes", "select o_orderkey, case o_orderkey % 10 when 1 then 'U' when 2 then 'R' else o_orderstatus end as o_orderstatus, o_custkey from orders where o_orderkey % 10 <> 0 union all select o_orderkey + 10000000000, 'N', o_custkey from orders where o_orderkey % 10 = 3")
def _tx_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return txn.merge_staged(*_staged_orders(spark, sf_dir), "o_orderkey")


@query("tx_point_read", "select o_orderkey, 'U' as o_orderstatus from orders where o_orderkey = 21 union all select o_orderkey, o_orderstatus from orders where o_orderkey in (24, 20) and o_orderkey % 10 <> 0")
def _tx_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = txn.merge_staged(*_staged_orders(spark, sf_dir), "o_orderkey")
    return merged.where(F.col("o_orderkey").isin(20, 21, 24)).select("o_orderkey", "o_orderstatus")


@query("tx_heap_read", "select l_orderkey, l_linenumber::bigint as l_linenumber from lineitem union all select l_orderkey, l_linenumber::bigint from lineitem where l_orderkey % 100 = 0")
def _tx_heap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table without a key only gains inserts."""
    lines = A.load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return txn.merge_heap(lines, lines.where("l_orderkey % 100 = 0").withColumn("_op", F.lit("insert")))


@query("tx_conflicts", "select user_id, 3000 - user_id % 2 as observed, event_id + 1 as published from (select user_id, max(event_id) as event_id from events group by user_id) where event_id + 1 <> 3000 - user_id % 2")
def _tx_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates that observed about commit 3000, against each user's newest version."""
    last = A.load(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("e"))
    staged = last.select("user_id", (3000 - F.col("user_id") % 2).alias("_observed"), F.lit("update").alias("_op"))
    return txn.conflicts(staged, last.select("user_id", (F.col("e") + 1).alias("_version")), "user_id")


@query("tx_round_unique", "select o_orderkey, o_orderkey = min(o_orderkey) over (partition by o_custkey) as won from orders")
def _tx_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of one commit round that claim a customer: the first in the queue wins."""
    return txn.round_winners(A.load(spark, sf_dir, "orders"), "o_custkey", "o_orderkey").select("o_orderkey", "won")


STAGED = "(select s_suppkey as key, s_acctbal < 0 as gone, case when s_nationkey <> 0 then 2 * (s_suppkey - s_suppkey % 2) end as slot from supplier)"


@query("tx_commit_unique", f"""
select slot::bigint as value from (select slot from {STAGED} where not gone union all select c_custkey from customer where c_custkey not in (select key from {STAGED}))
where slot is not null group by slot having count(*) > 1""")
def _tx_commit_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer holds the slot of its key; a write set updates or deletes a row per supplier and claims slots that others, or two of its rows, hold."""
    current = A.load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_custkey").alias("slot"))
    op = F.when(F.col("s_acctbal") < 0, "delete").otherwise("update")
    slot = F.when(F.col("s_nationkey") != 0, 2 * (F.col("s_suppkey") - F.col("s_suppkey") % 2))
    last = A.load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), slot.alias("slot"), op.alias("_op"))
    return txn.claimed_twice(last, current, "slot", "key").distinct()


@query("constraint_check", """
select 'primary_key' as "constraint", 'p_partkey' as "column", p_partkey::varchar as value, count(*) as n from part group by p_partkey having count(*) > 1
union all select 'unique', 'p_name', p_name, count(*) from part group by p_name having count(*) > 1
union all select 'not_null', 'p_brand', null, count(*) from part where p_brand is null having count(*) > 0""")
def _constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return txn.constraint_report(A.load(spark, sf_dir, "part"), "p_partkey", ["p_brand"], ["p_name"])


# --- sorted files

FLUSHED = "(select user_id, event_id % 4 as seq, max(event_id) as event_id, arg_max(event_type, event_id) = 'error' as deleted from events group by all)"
NEWEST = f"(select * from (select *, row_number() over (partition by user_id order by seq desc) as rn from {FLUSHED}) where rn = 1)"


@query("lsm_merge", f"select user_id, seq::bigint as _seq, event_id, deleted from {NEWEST}")
def _lsm_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return newest(A.flushes(spark, sf_dir), "user_id").select("user_id", "_seq", "event_id", F.col("_deleted").alias("deleted"))


@query("lsm_compact", f"select user_id, event_id from {NEWEST} where not deleted")
def _lsm_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact(A.flushes(spark, sf_dir), "user_id").select("user_id", "event_id")


@query("lsm_lookup", f"select user_id, event_id, deleted from {NEWEST} where user_id in (3, 5)")
def _lsm_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return newest(A.flushes(spark, sf_dir).where(F.col("user_id").isin(3, 5)), "user_id").select("user_id", "event_id", F.col("_deleted").alias("deleted"))


@query("wal_replay_order", "select event_id, row_number() over (order by event_id) as pos from events where event_id < 1000")
def _wal_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first thousand records of a log by commit order, numbered in blocks."""
    return replay_order(A.load(spark, sf_dir, "events").where("event_id < 1000"), "event_id", 100)


@query("wal_replay_log", "select event_id, row_number() over (order by event_id) as pos from events")
def _wal_replay_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records of a log by commit order, numbered in blocks."""
    return replay_order(A.load(spark, sf_dir, "events"), "event_id")


# --- vectors

_Q = "(select embedding::double[] as q from embeddings where vec_id = 0)"
_SCORES = {
    "dot": "list_dot_product(embedding::double[], q)",
    "cosine": "list_dot_product(embedding::double[], q) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(embedding::double[], embedding::double[])))",
    "l2": "-(list_dot_product(q, q) + list_dot_product(embedding::double[], embedding::double[]) - 2 * list_dot_product(embedding::double[], q))",
}


def _vector(metric: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        table = A.vectors(spark, sf_dir)
        first = table.where("vec_id = 0").select("embedding").first()
        if first is None:  # nothing to search for
            return table.limit(0).select(F.lit(0).cast("long").alias("rk"), "vec_id", F.lit(0.0).alias("score"))
        found = top_k(table, "embedding", list(first[0]), metric, 10)
        return found.select("rk", "vec_id", (F.round("score", 5) + 0.0).alias("score"))

    return run


def _searches(metric: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        table = A.vectors(spark, sf_dir)
        found = search(table, table.where("vec_id % 100 = 0"), "embedding", metric, 10)
        return found.select("query_id", "rk", F.col("id").alias("vec_id"), (F.round("score", 5) + 0.0).alias("score"))

    return run


_QS = "(select vec_id as query_id, embedding::double[] as q from embeddings where vec_id % 100 = 0)"

for _m, _s in _SCORES.items():
    QUERIES[f"vec_search_{_m}"] = _searches(_m)
    SQL[f"vec_search_{_m}"] = f"select query_id, rk, vec_id, round(raw, 5) + 0.0 as score from (select *, row_number() over (partition by query_id order by raw desc, vec_id) as rk from (select query_id, vec_id, {_s} as raw from embeddings, {_QS})) where rk <= 10"
    QUERIES[f"vec_topk_{_m}"] = _vector(_m)
    SQL[f"vec_topk_{_m}"] = f"select row_number() over (order by raw desc, vec_id) as rk, vec_id, round(raw, 5) + 0.0 as score from (select vec_id, {_s} as raw from embeddings, {_Q} order by raw desc, vec_id limit 10)"


# --- results


@query("batch_plan", "select c_custkey, (row_number() over (order by c_custkey) - 1) // 64 as batch from customer where c_mktsegment = 'MACHINERY'")
def _batch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch that each row of a result goes out in."""
    rows = bind(parse("from customer\n| where c_mktsegment = 'MACHINERY'\n| emit { c_custkey }"), CUSTOMER(spark, sf_dir))
    return batch_plan(rows, "c_custkey")


@query("text_rendering", "select c_custkey::varchar as c0, c_name as c1 from customer")
def _text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.streaming.batches import as_text

    return as_text(bind(parse("from customer\n| emit { c_custkey, c_name }"), CUSTOMER(spark, sf_dir)))


def catalog_of(spark: SparkSession, sf_dir: str) -> Catalog:
    """All adapters' collections in one catalog."""
    out = Catalog()
    for make in (_tables(*A.KEYS), A.labelled, A.documents, A.sales, A.places, A.part_sizes, A.evidence, A.user_table):
        for name, source in make(spark, sf_dir).sources.items():
            out.add(name, source)
    return out
