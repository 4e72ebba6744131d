"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws the key -ln(u) / w, with u from a hash of its id and w its quality weight;
ascending keys are a weighted order without replacement. A source with target t and size s is
taken whole floor(t / s) times; the rest of the budget goes to the documents first in key
order, by prefix sums of sizes.

Scale: a source is never sorted in one task. Its keys fall into slots whose sizes are summed
(map-side first); prefix sums over the slots tell which are in or out altogether, and only
the one slot that holds the budget's end is sorted. The number of slots follows the number of
documents, so that a slot's share of a source holding a third of them stays small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, n_words, shuffle_partitions

#: Documents that a slot of the largest source holds about.
SLOT_ROWS = 2000
#: No source is taken more often than this.
MOST_EPOCHS = 3


def clean_share(text: Column) -> Column:
    """A document's quality weight: the share of its characters that are no ASCII digits or symbols, 0.05 at least."""
    n = F.length(text)
    rest = F.length(F.regexp_replace(text, r"[\x21-\x40\x5B-\x60\x7B-\x7E]", ""))
    return F.when(n > 0, F.greatest(F.lit(0.05), rest / n)).otherwise(F.lit(1.0))


def uniform(id_text: Column, seed: str) -> Column:
    """In (0, 1), the same for the same id: 52 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(id_text, F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def _running(df: DataFrame, order: list, columns: dict[str, Column]) -> DataFrame:
    """df with, for each name, the sum of a column over this and all earlier rows in a total order.

    Distributed: rows are dealt by range, summed by part, and the parts' sums carried over.
    """
    part = df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).withColumn("_part", F.spark_partition_id())
    part = cut(part)
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = part.groupBy("_part").agg(*[F.sum(c).alias(f"_{k}") for k, c in columns.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    carried = sums.select("_part", *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in columns])
    out = part.join(F.broadcast(carried), "_part")
    return out.select(*df.columns, *[(F.sum(c).over(own) + F.col(f"_{k}")).alias(k) for k, c in columns.items()])


def source_targets(sizes: DataFrame, cycle: int = 3, most: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size and target of each row of sizes (source, source_size).

    Sources by code point, null last, weigh 1, 2, .. cycle, repeating. Targets share the sum of
    all sizes by weight; none exceeds `most` times its source's size, and what is cut off goes to
    the others by weight until no target is above. That is the level L with
    sum(min(most * size, weight * L)) = the sum of sizes: sources in the order of
    most * size / weight are at their limit as long as the level lies above.
    """
    ranked = _running(sizes, [F.col("source").asc_nulls_last()], {"_rank": F.lit(1)})
    ranked = ranked.withColumn("_w", ((F.col("_rank") - 1) % cycle + 1).cast("long")).withColumn("_cap", (F.col("source_size") * most).cast("long"))
    ranked = cut(ranked)
    total, weight = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("_w"), F.lit(0))).first()
    run = _running(ranked, [(F.col("_cap") / F.col("_w")).asc(), F.col("_rank").asc()], {"_caps": F.col("_cap"), "_ws": F.col("_w")})
    # a source is at its limit if the level that the others would get, it among them, reaches it
    left, rest = F.lit(total) - (F.col("_caps") - F.col("_cap")), F.lit(weight) - (F.col("_ws") - F.col("_w"))
    run = cut(run.withColumn("_full", F.col("_cap") / F.col("_w") <= left / rest))
    caps, ws = run.where("_full").agg(F.coalesce(F.sum("_cap"), F.lit(0)), F.coalesce(F.sum("_w"), F.lit(0))).first()
    share = F.lit(total - caps) * F.col("_w") / F.lit(max(weight - ws, 1))
    return run.select("source", "source_size", F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(share.cast("double")).alias("target"))


def mix_sources(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source", weight: Column | None = None, seed: str = "", row: Column | None = None) -> DataFrame:
    """One row per row of docs: id_col, size, source_size, target, taken, copies, source, key, row (an expression to carry along).

    A document of size words is taken `copies` times; taken = copies * size. The last document
    that a source's budget reaches is in if half of it fits. Null text has size 0; a null source
    is a source; ties in key go by id and size. The mix depends on ids, texts and seed only.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    w = clean_share(t) if weight is None else weight
    base = docs.select(
        F.col(id_col).alias("id"), F.col(source).alias("source"), n_words(t).alias("size"), w.cast("double").alias("w"), uniform(F.col(id_col).cast("string"), seed).alias("u"),
        (F.lit(None).cast("long") if row is None else row).alias("row"),
    ).select("id", "row", "source", "size", (-F.log(F.col("u")) / F.col("w")).alias("key"))
    base = cut(base)
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    sizes = cut(sizes)
    largest = sizes.agg(F.max("rows")).first()[0] or 0
    slots = max(16, -(-largest // SLOT_ROWS))
    targets = source_targets(sizes.drop("rows"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = cut(targets.withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")))
    slot = F.least(F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * slots), F.lit(slots - 1)).cast("int")
    base = base.withColumn("slot", slot)
    by_slot = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("t.source").eqNullSafe(F.col("s.source"))
    # the whole slots of a source come before the one that holds the budget's end
    ends = (
        base.groupBy("source", "slot").agg(F.sum("size").alias("in_slot")).withColumn("before", F.coalesce(F.sum("in_slot").over(by_slot), F.lit(0))).alias("s")
        .join(targets.alias("t"), same).where(F.col("before") + F.col("in_slot") >= F.col("budget"))
        .groupBy(F.col("t.source").alias("source")).agg(F.min(F.struct("slot", "before")).alias("end"))
    )
    plan = targets.alias("t").join(ends.alias("s"), same, "left").select("t.*", F.col("end.slot").alias("end_slot"), F.col("end.before").alias("end_before"))
    plan = cut(plan)
    placed = base.alias("s").join(plan.alias("t"), same).select("s.*", "source_size", "target", "whole", "budget", "end_slot", "end_before")
    inside = F.col("slot") == F.col("end_slot")
    order = Window.partitionBy("source", "slot").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("end_before") + F.sum("size").over(order) - F.col("size") / 2
    columns = ["id", "row", "size", "source_size", "target", "whole", "source", "key"]
    clear = placed.where(~F.coalesce(inside, F.lit(False))).select(*columns, F.coalesce((F.col("slot") < F.col("end_slot")).cast("long"), F.lit(1)).alias("more"))
    sorted_ = placed.where(inside).select(*columns, (middle <= F.col("budget")).cast("long").alias("more"))
    copies = F.col("whole") + F.col("more") * (F.col("whole") < MOST_EPOCHS).cast("long")
    return clear.unionByName(sorted_).select(
        F.col("id").alias(id_col), "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "source", "key", "row"
    )
