"""Transactions: staged writes, reads that see them, conflicts and constraints as joins."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.errors import EngineError

MAX_OPS, MAX_BYTES = 10_000, 64 << 20


def last_staged(staged: DataFrame, key: str, order: str = "_op_no") -> DataFrame:
    """Of each key's staged writes the last: combined before the shuffle."""
    return staged.groupBy(key).agg(F.max_by(F.struct(*[c for c in staged.columns if c != key]), order).alias("r")).select(key, "r.*")


def merge_staged(committed: DataFrame, staged: DataFrame, key: str) -> DataFrame:
    """A table as its transaction sees it: the last staged write replaces, hides or adds a row.

    staged has committed's columns, `_op` (insert, update or delete) and `_op_no`.
    """
    last = last_staged(staged, key)
    kept = committed.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.where(F.col("_op") != "delete").select(*committed.columns))


def merge_heap(committed: DataFrame, staged: DataFrame) -> DataFrame:
    """Tables without a key only gain the staged inserts."""
    return committed.unionByName(staged.where(F.col("_op") == "insert").select(*committed.columns))


def conflicts(staged: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Staged updates and deletes whose observed version isn't the published one: key, observed, published."""
    own = staged.where(F.col("_op") != "insert").select(key, F.col("_observed").alias("observed"))
    now = current.select(key, F.col("_version").alias("published"))
    return own.join(now, key, "left").where(~F.col("observed").eqNullSafe(F.col("published")))


def round_winners(staged: DataFrame, unique: str, position: str) -> DataFrame:
    """Of several requests in a commit round that claim one key, the first in the queue; `won` added."""
    first = staged.where(F.col(unique).isNotNull()).groupBy(unique).agg(F.min(position).alias("_first"))
    return staged.join(first, unique, "left").withColumn("won", F.coalesce(F.col(position) == F.col("_first"), F.lit(True))).drop("_first")


def claimed_twice(last: DataFrame, current: DataFrame, unique: str, key: str | None) -> DataFrame:
    """Values of a unique column that a write set's last writes claim although another row of it, or a published row that it leaves alone, holds them; nulls are free."""
    claims = last.where(F.col("_op") != "delete")
    left = current if key is None else current.join(last.select(key), key, "left_anti")
    claims, left = (df.where(F.col(unique).isNotNull()).select(F.col(unique).alias("value")) for df in (claims, left))
    twice = claims.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("value")
    return twice.unionByName(claims.join(left, "value", "left_semi"))


def constraint_report(table: DataFrame, key: str | None = None, not_null: list[str] = (), unique: list[str] = ()) -> DataFrame:
    """constraint, column, value, n: duplicate keys, nulls, and repeated unique values; nulls never repeat."""
    found = []
    for kind, columns in (("primary_key", [key] if key else []), ("unique", unique)):
        for c in columns:
            repeated = table.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            found.append(repeated.select(F.lit(kind).alias("constraint"), F.lit(c).alias("column"), "value", "n"))
    for c in [*([key] if key else []), *not_null]:
        nulls = table.where(F.col(c).isNull()).agg(F.count(F.lit(1)).alias("n")).where("n > 0")
        found.append(nulls.select(F.lit("not_null").alias("constraint"), F.lit(c).alias("column"), F.lit(None).cast("string").alias("value"), "n"))
    if not found:
        raise EngineError("InvalidSchema", "no constraint")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


@dataclass
class Transaction:
    """An ordered private write set on the driver, bounded by number and size."""

    begun_at: int
    state: str = "active"
    ops: list[dict] = field(default_factory=list)
    bytes: int = 0

    def stage(self, table: str, op: str, key, row: dict | None, observed: int | None = None) -> None:
        if self.state != "active":
            raise EngineError("TransactionNotActive", self.state)
        size = len(repr(row)) + len(repr(key))
        if len(self.ops) >= MAX_OPS or self.bytes + size > MAX_BYTES:
            self.state = "failed"
            raise EngineError("TransactionTooLarge")
        self.bytes += size
        self.ops.append({"table": table, "op": op, "key": key, "row": row, "observed": observed, "no": len(self.ops)})

    def of(self, table: str) -> list[dict]:
        return [o for o in self.ops if o["table"] == table]

