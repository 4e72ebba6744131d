"""A training corpus from the documents: each stage calls one operator of quern.llm.

Between stages the documents lie as Parquet files, so a stage reads the same rows as often as it
likes; rows are told apart by their file and their place in it. A stage works with column names
of its own beside the documents' columns, whatever these are called. An empty table passes
through every stage, null texts count as empty, and texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import cut, free_name, new_dir, numbered, remove_dir, table
from quern.llm.exact_dedup import exact_dedup
from quern.llm.mixing import mix_sources
from quern.llm.near_dedup import near_dedup
from quern.llm.packing import pack_documents
from quern.llm.toxicity import score_toxicity

#: No SQL gives the rows: models, sketches and a tokenizer decide.
ORACLE_SQL = None
#: Near copies share so many per cent of their shingles, or more.
NEAR_PERCENT = 80


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that aren't predicted toxic, by models learnt from the labels. Repeated rows all stay or all go."""
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    own = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias(names["doc_id"]), "toxic")
    scored = score_toxicity(own, labels, names["text"], names["doc_id"], keep=tuple(names.values()))
    return scored.where("predicted = 0").select(*[F.col(n).alias(c) for c, n in names.items()])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the largest id; null ids come last, and of repeated rows one stays."""
    row = free_name(docs, "_row")
    rows = numbered(docs, row)
    dropped = cut(exact_dedup(rows.select("doc_id", "text", row), row=F.col(row)).where("not kept").select(F.col("_row").alias(row)))
    return rows.join(dropped, row, "left_anti").select(*_columns(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, the one with the smallest id, null being the largest; of one id's rows the first. Texts without words all stay."""
    row = free_name(docs, "_row")
    rows = numbered(docs, row)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col(row).alias("row"))  # tells rows apart, whatever their ids
    found = near_dedup(rows.select(place.alias("place"), "text"), id_col="place", percent=NEAR_PERCENT)
    dropped = cut(found.where("not kept").select(F.col("place.row").alias(row)))
    return rows.join(dropped, row, "left_anti").select(*_columns(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. A null source is a source; documents without words have no size and may come in or not."""
    row, copies = free_name(docs, "_row"), free_name(docs, "_copies")
    rows = numbered(docs, row)
    taken = mix_sources(rows.select("doc_id", "text", "source", row), row=F.col(row)).where("copies > 0")
    taken = cut(taken.select(F.col("row").alias(row), F.array_repeat(F.lit(0), F.col("copies").cast("int")).alias(copies)))
    return rows.join(taken, row).select(*_columns(docs), F.explode(copies).alias(copies)).select(*_columns(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences; a null or empty text is one piece that holds the end id."""
    return pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mix_sources", mix), ("pack_best_fit", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents, each one's rows written and read again by the next."""
    docs, folder = table(spark, sf_dir, "documents"), new_dir(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    out = cut(STAGES[-1][1](spark, docs, sf_dir))
    remove_dir(spark, folder)
    return out
