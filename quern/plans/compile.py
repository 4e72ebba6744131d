"""Binding: a valid request and a catalog give a lazy DataFrame, or BindError before any job runs.

Every stage becomes a projection, filter, equi-join or top-n of the DataFrame API, so filters and
columns reach the scan and joins are chosen by the optimizer. Only `limit` asks for order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.errors import BindError
from quern.functions.cells import CELL, cell
from quern.functions.predicates import all_of, check_typed, declared, tagged, typed
from quern.operators.versions import visible
from quern.sources.catalog import EVIDENCE_SCHEMA, Catalog, Documents, Evidence, Graph, Kv, Part, Relation

from .request import MODEL_REVISION, Emit, Predicate, validate


def _named(columns: list[Column], names: tuple[str, ...]) -> list[Column]:
    return [c.alias(n) for c, n in zip(columns, names)]


def _ordered(df: DataFrame, request: Emit, order: list[str]) -> DataFrame:
    return df if request.limit is None else df.orderBy(*order).limit(request.limit)


def _bind_typed(df: DataFrame, columns: dict, request: Emit) -> DataFrame:
    """Declared columns: `where` finds a name in any case, `emit` only as it is written."""
    folded = {name.lower(): name for name in reversed(columns)}
    tests = []
    for p in request.where:
        name = folded.get(p.path.lower())
        if name is None:
            raise BindError("FieldNotFound", p.path)
        check_typed(p, columns[name])
        tests.append(typed(p, F.col(f"`{name}`")))
    for name in request.fields:
        if name not in columns:
            raise BindError("FieldNotFound", name)
    kept = _ordered(df.where(all_of(tests)), request, ["_row_seq"])
    return kept.select(*_named([F.col(f"`{n}`") for n in request.fields], request.fields))


def _bind_cells(df: DataFrame, request: Emit, strict_types: bool) -> DataFrame:
    """Paths in a map, without declared types: one that a row lacks reads null."""
    cell_at = lambda path: F.try_element_at("fields", F.lit(path))
    kept = _ordered(df.where(all_of([tagged(p, cell_at(p.path), strict_types) for p in request.where])), request, ["_row_seq"])
    return kept.select(*_named([cell_at(n) for n in request.fields], request.fields))


def _test(part: Part, p: Predicate, strict_types: bool) -> Column:
    kind, value = part.of(p.path) or (None, None)
    return declared(p, kind, value, strict_types)


def _cell_of(part: Part, path: str) -> Column:
    found = part.of(path)
    return cell(*found) if found else F.lit(None).cast(CELL.simpleString())


def _from_parts(parts: tuple[Part, ...], tests: tuple[Predicate, ...], fields: list[str], strict_types: bool) -> DataFrame:
    """id, _row_seq and the fields' cells as _0, _1, ..: each part by itself, with only what is asked of it."""
    out = None
    for part in parts:
        rows = part.frame({*fields, *(p.path for p in tests)}).where(all_of([_test(part, p, strict_types) for p in tests]))
        own = rows.select("id", "_row_seq", *[_cell_of(part, f).alias(f"_{i}") for i, f in enumerate(fields)])
        out = own if out is None else out.unionByName(own)
    return out


def _bind_parts(parts: tuple[Part, ...], request: Emit, strict_types: bool) -> DataFrame:
    kept = _ordered(_from_parts(parts, request.where, list(request.fields), strict_types), request, ["_row_seq"])
    return kept.select(*_named([F.col(f"_{i}") for i in range(len(request.fields))], request.fields))


def _navigate(graph: Graph, request: Emit, strict_types: bool) -> DataFrame:
    """One hop: source nodes that pass, their edges of that label, and the targets that exist."""
    alias = request.navigate.alias + "."
    behind = [n[len(alias) :] if n.startswith(alias) else None for n in request.fields]
    edges = graph.edges.where(F.col("label") == request.navigate.edge).select(F.col("source").alias("_source"), F.col("target").alias("_target"), F.col("_row_seq").alias("_edge_seq"))
    here, there = [n for n, b in zip(request.fields, behind) if b is None], [b for b in behind if b is not None]
    if graph.parts:
        near = _from_parts(graph.parts, request.where, here, strict_types)
        far = _from_parts(graph.parts, (), there, strict_types)
    else:
        tests = [tagged(p, F.try_element_at("fields", F.lit(p.path)), strict_types) for p in request.where]
        read = lambda names: [F.try_element_at("fields", F.lit(n)).alias(f"_{i}") for i, n in enumerate(names)]
        near, far = graph.nodes.where(all_of(tests)).select("id", "_row_seq", *read(here)), graph.nodes.select("id", *read(there))
    near = near.select(F.col("id").alias("_source"), F.col("_row_seq").alias("_node_seq"), *[F.col(f"_{i}").alias(f"_near{i}") for i in range(len(here))])
    far = far.select(F.col("id").alias("_target"), *[F.col(f"_{i}").alias(f"_far{i}") for i in range(len(there))])
    pairs = near.join(edges, "_source").join(far, "_target")
    at = {"near": iter(range(len(here))), "far": iter(range(len(there)))}
    columns = [F.col(f"_near{next(at['near'])}") if b is None else F.col(f"_far{next(at['far'])}") for b in behind]
    return _ordered(pairs, request, ["_node_seq", "_edge_seq"]).select(*_named(columns, request.fields))


def bind(request: Emit, catalog: Catalog, snapshot: int | None = None, strict_types: bool = False, rows: Callable[[Relation], DataFrame] | None = None) -> DataFrame:
    """The request's result, columns named as emitted; cells where the collection has no types.

    snapshot: the commit sequence that versioned tables are read at. rows: gives a table's rows
    instead, as a transaction does.
    """
    validate(request)
    source = catalog.find(request.source)
    if request.revision != MODEL_REVISION:
        raise BindError("ModelRevisionMismatch", str(request.revision))
    if request.navigate and not isinstance(source, Graph):
        raise BindError("UnsupportedNavigate", request.source)
    match source:
        case Relation():
            df = rows(source) if rows else source.df
            if source.versioned and not rows:
                df = df.where(visible(snapshot) if snapshot is not None else F.col("_deleted_seq").isNull())
            return _bind_typed(df, source.columns, request)
        case Evidence():
            columns = {f.name: f.dataType for f in EVIDENCE_SCHEMA.fields}
            return _bind_typed(source.df.withColumn("_row_seq", F.col("evidence_id")), columns, request)
        case Documents():
            if source.parts:
                return _bind_parts(source.parts, request, strict_types)
            return _bind_cells(source.df, request, strict_types)
        case Graph():
            if request.navigate:
                return _navigate(source, request, strict_types)
            if source.parts:
                return _bind_parts(source.parts, request, strict_types)
            return _bind_cells(source.nodes, request, strict_types)
        case Kv():
            nothing = F.lit(None).cast(CELL.simpleString())
            shown = {"key": F.col("key"), "value": F.col("value")}
            tests = [tagged(p, F.col("value"), strict_types) if p.path == "value" else declared(p, "text" if p.path == "key" else None, F.col("key"), strict_types) for p in request.where]
            kept = _ordered(source.df.where(all_of(tests)), request, ["_row_seq"])
            return kept.select(*_named([shown.get(n, nothing) for n in request.fields], request.fields))
    raise BindError("InvalidOperation", request.source)
