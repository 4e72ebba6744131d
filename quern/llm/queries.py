"""The queries opN_<name> over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_turns, read_back
from .common import table
from .embedding_dedup import embedding_dedup
from .exact_dedup import exact_dedup
from .html_extract import extract_main
from .licenses import scan_licenses
from .lm_score import score_documents
from .mixing import mix_sources
from .near_dedup import near_dedup
from .packing import pack_documents
from .toxicity import score_toxicity

#: A conversation whose texts hold control strings and backslashes, beside those of the table.
TRICKY = r"\### Assistant: </turn> ok"


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("_row")


def op3_scan_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files <source>/<lang>/<doc_id>; none is a licence file, so nothing is inherited."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.col("doc_id").cast("string"))
    files = table(spark, sf_dir, "documents").select("doc_id", "text", path.alias("path"))
    return scan_licenses(files, keep=("doc_id",)).select("doc_id", "path", "license", F.round("score", 6).alias("score"), "inherited")


def op4_format_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], turns.schema)
    return read_back(format_turns(turns.unionByName(tricky)))


def op5_pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_extract_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main(table(spark, sf_dir, "pages"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), percent=85)


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_scan_licenses": op3_scan_licenses,
    "op4_format_chat": op4_format_chat,
    "op5_pack_best_fit": op5_pack_best_fit,
    "op6_toxicity": op6_toxicity,
    "op7_extract_main": op7_extract_main,
    "op8_lm_score": op8_lm_score,
    "op9_near_dedup": op9_near_dedup,
    "op10_embedding_dedup": op10_embedding_dedup,
}

OP1_SQL = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    case when coalesce(text, '') <> '' then greatest(0.05, length(regexp_replace(text, '[\x21-\x40\x5B-\x60\x7B-\x7E]', '', 'g'))::double / length(text)) else 1.0 end as w,
    (('0x' || substr(md5(coalesce(doc_id::varchar, 'null')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0 as u
  from documents
), k as (select *, -ln(u) / w as key from d
), s as (
  select source, sum(size)::bigint as source_size, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::bigint as wt,
    row_number() over (order by source nulls last) as rk
  from d group by source
), r as (
  select *, 3 * source_size as cap, (3 * source_size)::double / wt as ratio,
    (sum(source_size) over ())::bigint as total, (sum(wt) over ())::bigint as weights
  from s
), c as (
  select *, coalesce(sum(cap) over o, 0)::bigint as caps, coalesce(sum(wt) over o, 0)::bigint as wts
  from r window o as (order by ratio, rk rows between unbounded preceding and 1 preceding)
), f as (select *, ratio <= (total - caps)::double / (weights - wts) as is_full from c
), g as (
  select *, coalesce(sum(case when is_full then cap end) over (), 0)::bigint as fcaps, coalesce(sum(case when is_full then wt end) over (), 0)::bigint as fwts from f
), t as (
  select source, source_size, case when is_full then cap::double else ((total - fcaps) * wt)::double / greatest(weights - fwts, 1) end as target from g
), e as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as whole from t
), p as (
  select k.doc_id, k.size, e.source_size, e.target, e.whole, e.target - e.whole * e.source_size as budget,
    sum(k.size) over (partition by k.source order by k.key, k.doc_id, k.size rows unbounded preceding) - k.size / 2.0 as middle
  from k join e on k.source is not distinct from e.source
)
select doc_id, size, source_size, target, (size * (whole + case when middle <= budget and whole < 3 then 1 else 0 end))::bigint as taken from p
"""

OP2_SQL = """
select doc_id, max(doc_id) over g as keep_id, (count(*) over g)::bigint as group_size,
  doc_id = max(doc_id) over g as kept, sha256(coalesce(text, '')) as text_sha256
from documents window g as (partition by coalesce(text, ''))
"""

OP4_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e as (
  select *, replace(replace(replace(replace(replace(replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'),
    '### System:', '#\## System:'), '### User:', '#\## User:'), '### Assistant:', '#\## Assistant:'), '### Tool:', '#\## Tool:'),
    '### Role:', '#\## Role:'), '### End:', '#\## End:') as escaped
  from t
)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length('### ' || role || ': ' || escaped || '</turn>' || chr(10)))::bigint as formatted_chars
from e group by conv_id
"""

SQL = {"op4_format_chat": OP4_SQL, "op1_mix_sources": OP1_SQL, "op2_exact_dedup": OP2_SQL}
