"""What a client calls: source text or bytes in, DataFrames or batches out."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from quern.errors import BindError, EngineError, IrError
from quern.operators.ingest import apply
from quern.plans.codec import decode
from quern.plans.compile import bind
from quern.plans.parser import parse
from quern.plans.request import Emit, Request
from quern.sources.catalog import Catalog
from quern.streaming.batches import Metrics, Registry, Row, drain, stream, tool_result


class Session:
    """One client's view of a catalog."""

    def __init__(self, spark: SparkSession, catalog: Catalog | None = None, strict_types: bool = False):
        self.spark, self.catalog, self.strict_types = spark, catalog or Catalog(), strict_types
        self.registry = Registry(spark)
        self.statement = self.registry.open()
        self.metrics = Metrics()

    def request(self, text: str | bytes | Request) -> Request:
        """Source text, canonical bytes and requests give the same result."""
        if isinstance(text, str):
            return parse(text)
        return decode(text) if isinstance(text, bytes) else text

    def frame(self, text: str | bytes | Request, snapshot: int | None = None) -> DataFrame:
        request = self.request(text)
        if not isinstance(request, Emit):
            raise BindError("InvalidOperation", type(request).__name__)
        return bind(request, self.catalog, snapshot, self.strict_types)

    def stream(self, text: str | bytes | Request, **bounds) -> Iterator[list[Row]]:
        df = self.frame(text)
        canceled = self.registry.start(self.statement)
        try:
            yield from stream(df, canceled=canceled, metrics=self.metrics, **bounds)
        finally:
            self.registry.finish(self.statement)

    def execute(self, text: str | bytes | Request) -> list[Row]:
        return drain(self.frame(text), metrics=self.metrics)

    def cancel(self) -> bool:
        return self.registry.cancel(self.statement.credential)

    def write(self, request: bytes | Request, payload: bytes | None = None) -> dict:
        request = self.request(request)
        if isinstance(request, Emit):
            raise IrError("InvalidOperation", "a read isn't a write")
        return apply(self.spark, self.catalog, request, payload)

    def tool(self, arguments: dict) -> dict:
        """A tool call: {source} in, structured content or an error's text out."""
        try:
            return {"isError": False, "structuredContent": tool_result(self.frame(arguments["source"]))}
        except EngineError as e:
            return {"isError": True, "content": [{"type": "text", "text": str(e)}]}
