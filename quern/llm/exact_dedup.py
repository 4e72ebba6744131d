"""Exact duplicates by deterministic block naming, with DataFrame functions only.

A text is cut into blocks of a fixed number of UTF-8 bytes. Equal blocks get equal integer
names: the blocks of a bucket are sorted and ranked. Adjacent names are then paired and the
pairs named in the same way, until each text has one name. Names come from comparing whole
blocks and pairs, so different texts never share one; hashes only choose buckets.

Scale: the texts are shuffled once, in blocks. A block that fills more than a fraction of a
bucket's share (found by counting hashes beforehand) is dealt out over many salted buckets,
and each of those sends one representative to a second, small naming. Pairs are aggregated
before they are named, and the join back to the names can be split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions

BLOCK_BYTES = 8192
#: Buckets per shuffle partition, so that partitions get about as many rows each.
BUCKETS = 32


def _blocks(text, size: int):
    raw = text.cast("binary")
    last = F.greatest(F.floor((F.octet_length(raw) - 1) / F.lit(size)), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(raw, i * size + 1, F.lit(size)))


def _bucket(h, n: int):
    return F.pmod(h, F.lit(n))


def _name_blocks(docs: DataFrame, text: str, id_col: str, block_bytes: int, row: Column) -> DataFrame:
    """_row, id, sha, blocks, idx, name: one row per block."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    n = parts * BUCKETS
    whole = F.coalesce(F.col(text), F.lit(""))
    pieces = (
        docs.select(F.col(id_col).alias("id"), whole.alias("text"), row.alias("_row"))
        .select("id", "_row", F.sha2(F.col("text"), 256).alias("sha"), _blocks(F.col("text"), block_bytes).alias("b"))
        .select("id", "_row", "sha", F.size("b").alias("blocks"), F.posexplode("b").alias("idx", "block"))
        .withColumn("sha", F.when(F.col("idx") == 0, F.col("sha")))
        .withColumn("h", F.xxhash64("block"))
    )
    # at most 8 * parts hashes are as frequent as this, whatever the input
    counts = docs.select(F.explode(_blocks(whole, block_bytes)).alias("block")).groupBy(F.xxhash64("block").alias("h")).count()
    counts = cut(counts)
    total = counts.agg(F.sum("count")).first()[0] or 0
    hot = counts.where(F.col("count") > max(1, total // (8 * parts))).select("h", F.lit(True).alias("hot"))
    pieces = pieces.join(F.broadcast(hot), "h", "left")
    salted = F.lit(n) + _bucket(F.xxhash64("_row", "idx"), parts)
    pieces = pieces.withColumn("bucket", F.when(F.col("hot"), salted).otherwise(_bucket(F.col("h"), n)))
    by = Window.partitionBy("bucket").orderBy("block")
    ranked = pieces.withColumn("rank", F.dense_rank().over(by)).withColumn("_before", F.lag("block").over(by))
    ranked = ranked.select(
        "_row", "id", "sha", "blocks", "idx", "bucket", "rank",
        F.when(F.col("hot") & ~F.col("block").eqNullSafe(F.col("_before")), F.col("block")).alias("speaker"),
    )
    ranked = cut(ranked)
    # one block of each kind in a salted bucket speaks for the others there
    again = Window.partitionBy(_bucket(F.xxhash64("speaker"), n)).orderBy("speaker")
    hot_names = (
        ranked.where(F.col("speaker").isNotNull())
        .select("bucket", "rank", (F.dense_rank().over(again) * F.lit(2 * n) + F.lit(n) + _bucket(F.xxhash64("speaker"), n)).cast("long").alias("hot_name"))
    )
    name = F.coalesce(F.col("hot_name"), F.col("rank").cast("long") * F.lit(2 * n) + F.col("bucket"))
    return ranked.drop("speaker").join(cut(hot_names), ["bucket", "rank"], "left").withColumn("name", name).drop("bucket", "rank", "hot_name")


def _name_pairs(names: DataFrame) -> DataFrame:
    """_row, idx, name of the next level: each pair of adjacent names gets one; -1 stands for none."""
    n = shuffle_partitions(names.sparkSession) * BUCKETS
    pairs = names.groupBy("_row", F.floor(F.col("idx") / 2).cast("int").alias("idx")).agg(
        F.max(F.when(F.col("idx") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("idx") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b")
    )
    pairs = cut(pairs)
    bucket = _bucket(F.xxhash64("a", "b"), n)
    by = Window.partitionBy(bucket).orderBy("a", "b")
    named = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).select("a", "b", (F.row_number().over(by).cast("long") * F.lit(n) + bucket).alias("name"))
    return cut(pairs.join(cut(named), ["a", "b"]).select("_row", "idx", "name"))


def name_documents(docs: DataFrame, text: str = "text", id_col: str = "doc_id", block_bytes: int = BLOCK_BYTES, row: Column | None = None) -> DataFrame:
    """One row per row of docs: _row, id, sha (SHA-256 of the text, hex), blocks, name.

    Two rows have equal (blocks, name) exactly when their texts are equal; null counts as empty.
    """
    level = cut(_name_blocks(docs, text, id_col, block_bytes, F.monotonically_increasing_id() if row is None else row))
    heads = level.where("idx = 0").select("_row", "id", "sha", "blocks", "name")
    most = level.agg(F.max("blocks")).first()[0] or 1
    done, level = heads.where("blocks = 1"), level.where("blocks > 1").select("_row", "idx", "name")
    width = most
    while width > 1:
        level, width = _name_pairs(level), (width + 1) // 2
    if most > 1:
        done = done.unionByName(heads.where("blocks > 1").drop("name").join(level.select("_row", "name"), "_row"))
    return done


def exact_dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id", block_bytes: int = BLOCK_BYTES, row: Column | None = None) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256, _row.

    Of equal texts the row with the largest id stays; null ids come last, and of repeated rows
    with one id exactly one stays. Null text equals empty text. Other columns aren't read, and
    an empty table gives no rows. _row is the expression row, which must tell docs' rows apart, or
    else numbers them in scan order.
    """
    named = cut(name_documents(docs, text, id_col, block_bytes, row))
    groups = named.groupBy("blocks", "name").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("id", "_row")).alias("last")).where("group_size > 1")
    size, last = F.coalesce(F.col("group_size"), F.lit(1)).cast("long"), F.col("last._row")
    return named.join(cut(groups), ["blocks", "name"], "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("last.id")).alias("keep_id"),
        size.alias("group_size"),
        F.coalesce(last == F.col("_row"), F.lit(True)).alias("kept"),
        F.col("sha").alias("text_sha256"),
        "_row",
    )
