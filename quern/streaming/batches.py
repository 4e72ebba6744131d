"""Results in bounded batches, with cancelling and counts.

Rows come from the executors one partition at a time, so the driver holds a partition and a batch.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.errors import Canceled, EngineError
from quern.functions.cells import render_text

# fixed values: bounds of a batch and of a tool's answer
BATCH_ROWS, BATCH_BYTES = 64, 1 << 20
TOOL_ROWS, TOOL_CELL_BYTES, TOOL_BYTES = 1_000, 64 << 10, 1 << 20

Row = tuple[str | None, ...]


@dataclass
class Metrics:
    batches: int = 0
    rows: int = 0
    bytes: int = 0
    cancel_checks: int = 0
    largest_batch: int = 0


def as_text(df: DataFrame) -> DataFrame:
    """Every column as result text; duplicate names stay."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).select(*[render_text(F.col(f"c{i}"), f.dataType).alias(f"c{i}") for i, f in enumerate(df.schema.fields)])


def stream(df: DataFrame, rows: int = BATCH_ROWS, size: int = BATCH_BYTES, canceled: Callable[[], bool] = lambda: False, metrics: Metrics | None = None) -> Iterator[list[Row]]:
    """Batches of text rows. The bounds are looked at before each row, so a large row still goes out.

    canceled is asked before each row; when it says so, Canceled is raised and rows so far stay sent.
    """
    metrics = metrics if metrics is not None else Metrics()
    batch, held = [], 0

    def done() -> list[Row]:
        nonlocal batch, held
        out = batch
        metrics.batches += 1
        metrics.largest_batch = max(metrics.largest_batch, len(out))
        batch, held = [], 0
        return out

    for row in as_text(df).toLocalIterator(prefetchPartitions=True):
        metrics.cancel_checks += 1
        if canceled():
            raise Canceled()
        if batch and (len(batch) >= rows or held >= size):
            yield done()
        batch.append(tuple(row))
        width = sum(len(c.encode()) for c in row if c is not None)
        held, metrics.rows, metrics.bytes = held + width, metrics.rows + 1, metrics.bytes + width
    if batch:
        yield done()


def drain(df: DataFrame, **options) -> list[Row]:
    """The whole result: all batches joined."""
    return [row for batch in stream(df, **options) for row in batch]


def batch_plan(df: DataFrame, order: str, rows: int = BATCH_ROWS) -> DataFrame:
    """df with the number of the batch that each row goes out in, by row count alone.

    The rows' places come from prefix sums over ranges of the order, not from one sorted task.
    Rows without a place in the order come first.
    """
    block = F.coalesce(F.floor(F.col(order) / 65536), F.lit(-(1 << 62)))
    counts = df.groupBy(block.alias("_block")).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_block", F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = Window.partitionBy("_block").orderBy(order)
    placed = df.withColumn("_block", block).join(before, "_block")
    return placed.withColumn("batch", F.floor((F.col("_before") + F.row_number().over(own) - 1) / rows).cast("long")).drop("_block", "_before")


@dataclass
class Statement:
    """One running statement that a holder of its credential can cancel; later ones aren't touched."""

    credential: str = field(default_factory=lambda: uuid.uuid4().hex)
    flag: threading.Event = field(default_factory=threading.Event)
    generation: int = 0


class Registry:
    """Statements by credential."""

    def __init__(self, spark, capacity: int = 1024):
        self.spark, self.capacity, self.statements = spark, capacity, {}

    def open(self) -> Statement:
        if len(self.statements) >= self.capacity:
            raise EngineError("ConnectionLimitExceeded")
        s = Statement()
        self.statements[s.credential] = s
        return s

    def close(self, s: Statement) -> None:
        self.statements.pop(s.credential, None)

    def start(self, s: Statement) -> Callable[[], bool]:
        """A new statement of a connection; what cancels an earlier one doesn't reach it."""
        s.generation += 1
        s.flag = threading.Event()
        self.spark.addTag(f"{s.credential}-{s.generation}")
        return s.flag.is_set

    def finish(self, s: Statement) -> None:
        self.spark.removeTag(f"{s.credential}-{s.generation}")

    def cancel(self, credential: str) -> bool:
        """Whether a live connection has that credential; its current statement stops."""
        s = self.statements.get(credential)
        if s is None:
            return False
        s.flag.set()
        self.spark.interruptTag(f"{credential}-{s.generation}")
        return True


def tool_result(df: DataFrame) -> dict:
    """Columns and text rows of a small result, or EngineError where a bound is passed."""
    found = as_text(df).limit(TOOL_ROWS + 1).collect()
    if len(found) > TOOL_ROWS:
        raise EngineError("ResultTooLarge", "rows")
    total = 0
    for row in found:
        for c in row:
            size = len(c.encode()) if c is not None else 0
            if size > TOOL_CELL_BYTES:
                raise EngineError("ResultTooLarge", "a cell")
            total += size
    if total > TOOL_BYTES:
        raise EngineError("ResultTooLarge", "bytes")
    return {"columns": df.columns, "rows": [list(r) for r in found]}
