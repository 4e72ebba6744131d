"""Named collections: what a request's `from` finds. Each holds DataFrames with a hidden `_row_seq`."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.errors import BindError, EngineError
from quern.functions.cells import cell, fields_map

#: The evidence view's fixed name and columns.
EVIDENCE = "observation_evidence"
EVIDENCE_SCHEMA = T.StructType(
    [T.StructField(n, T.LongType() if n in ("evidence_id", "payload_length") else T.StringType())
     for n in ("evidence_id", "object_id", "modality", "media_type", "observed_at", "origin", "owner", "payload_length", "payload_digest")]
)


@dataclass
class Relation:
    """A table. With versioned, rows carry _created_seq and _deleted_seq, and a read sees one moment."""

    df: DataFrame
    key: str | None = None
    versioned: bool = False

    @property
    def columns(self) -> dict[str, T.DataType]:
        return {f.name: f.dataType for f in self.df.schema.fields if not f.name.startswith("_")}


@dataclass
class Side:
    """Further columns of a part: df has at most one row for each value of its column `on`."""

    df: DataFrame
    on: str
    paths: dict[str, tuple[str, str]]


@dataclass
class Part:
    """Rows of one shape: id, _row_seq and columns; paths gives each dotted path's type and column.

    A path is bound to its column, so tests reach the scan, only the columns asked for are read,
    and a side is joined only where one of its paths is asked for.
    """

    df: DataFrame
    paths: dict[str, tuple[str, str]]
    sides: tuple[Side, ...] = ()

    def of(self, path: str) -> tuple[str, Column] | None:
        """Type and column of a path, None if these rows don't have it."""
        for paths in (self.paths, *(s.paths for s in self.sides)):
            if path in paths:
                return paths[path][0], F.col(f"`{paths[path][1]}`")
        return None

    def frame(self, asked: set[str]) -> DataFrame:
        out = self.df
        for s in self.sides:
            if asked & set(s.paths):
                out = out.join(s.df, s.on, "left")
        return out

    def cells(self) -> DataFrame:
        """id, fields, _row_seq."""
        every = [*self.paths, *(p for s in self.sides for p in s.paths)]
        return self.frame(set(every)).select("id", fields_map({p: cell(*self.of(p)) for p in every}).alias("fields"), "_row_seq")


def _union(parts: tuple[Part, ...]) -> DataFrame:
    out = parts[0].cells()
    for p in parts[1:]:
        out = out.unionByName(p.cells())
    return out


@dataclass
class Documents:
    """id, fields (a map of dotted paths to cells), _row_seq; or parts of declared shapes, from which df follows."""

    df: DataFrame | None = None
    parts: tuple[Part, ...] = ()

    def __post_init__(self):
        if self.df is None:
            self.df = _union(self.parts)


@dataclass
class Graph:
    """nodes as documents; edges (source, label, target, _row_seq)."""

    nodes: DataFrame | None
    edges: DataFrame
    parts: tuple[Part, ...] = ()

    def __post_init__(self):
        if self.nodes is None:
            self.nodes = _union(self.parts)


@dataclass
class Kv:
    """A log of puts (key, value cell, _row_seq): a key keeps its first place and has its last value."""

    log: DataFrame

    @property
    def df(self) -> DataFrame:
        return self.log.groupBy("key").agg(F.max_by("value", "_row_seq").alias("value"), F.min("_row_seq").alias("_row_seq"))


@dataclass
class Evidence:
    """Metadata with the view's columns; payloads (evidence_id, payload) are read by id only."""

    df: DataFrame
    payloads: DataFrame | None = None


Source = Relation | Documents | Graph | Kv | Evidence


@dataclass
class Catalog:
    """One flat set of names; a name belongs to one collection of any kind."""

    sources: dict[str, Source] = field(default_factory=dict)

    def add(self, name: str, source: Source) -> "Catalog":
        if name in self.sources or (name == EVIDENCE) != isinstance(source, Evidence):
            raise EngineError("TableExists" if name in self.sources else "InvalidName", name)
        self.sources[name] = source
        return self

    def replace(self, name: str, source: Source) -> None:
        self.sources[name] = source

    def find(self, name: str) -> Source:
        if name not in self.sources:
            raise BindError("SemanticNameNotFound", name)
        return self.sources[name]


def widen(df: DataFrame) -> DataFrame:
    """Smaller integers as bigint, the one integer type of the language."""
    small = (T.ByteType, T.ShortType, T.IntegerType)
    return df.select(*[F.col(f"`{f.name}`").cast("bigint").alias(f.name) if isinstance(f.dataType, small) else F.col(f"`{f.name}`") for f in df.schema.fields])


def relation(df: DataFrame, row_seq: Column, key: str | None = None) -> Relation:
    """A table whose insertion order is given by an expression."""
    return Relation(widen(df).withColumn("_row_seq", row_seq.cast("bigint")), key)
