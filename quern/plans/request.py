"""Requests: one read form and six writes, as plain values with one set of rules."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from quern.errors import IrError

Literal = int | str | bool
Scalar = int | str | bool | None

IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
PATH = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*\Z")
COMPARISONS = ("eq", "neq", "lt", "lte", "gt", "gte")
OPERATORS = (*COMPARISONS, "is_null", "not_null", "in", "not_in", "like", "not_like")
MODALITIES = {1: "text", 2: "image", 3: "audio", 4: "video", 5: "sensor", 6: "other"}
MODEL_REVISION = 0


def is_identifier(name: str) -> bool:
    return bool(IDENTIFIER.match(name))


def is_path(name: str) -> bool:
    return bool(PATH.match(name))


def tag(value: Scalar) -> str:
    """The type tag of a literal or scalar."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, str):
        return "text"
    raise IrError("UnsupportedValue", type(value).__name__)


@dataclass(frozen=True)
class Predicate:
    path: str
    op: str
    value: Literal | None = None
    values: tuple[Literal, ...] = ()


@dataclass(frozen=True)
class Navigate:
    edge: str
    alias: str


@dataclass(frozen=True)
class Emit:
    source: str
    fields: tuple[str, ...]
    where: tuple[Predicate, ...] = ()
    limit: int | None = None
    navigate: Navigate | None = None
    revision: int = MODEL_REVISION


@dataclass(frozen=True)
class Observe:
    upload_id: int
    object_id: str
    modality: int
    media_type: str
    observed_at: str
    origin: str


@dataclass(frozen=True)
class ReadPayload:
    evidence_id: int


@dataclass(frozen=True)
class InsertDocument:
    collection: str
    id: str
    fields: tuple[tuple[str, Scalar], ...] = field(default_factory=tuple)


@dataclass(frozen=True)
class AddNode:
    graph: str
    id: str
    fields: tuple[tuple[str, Scalar], ...] = field(default_factory=tuple)


@dataclass(frozen=True)
class AddEdge:
    graph: str
    source: str
    label: str
    target: str


@dataclass(frozen=True)
class PutKv:
    collection: str
    key: str
    item: Scalar


Request = Emit | Observe | ReadPayload | InsertDocument | AddNode | AddEdge | PutKv


def _need(ok: object, kind: str, what: str = "") -> None:
    if not ok:
        raise IrError(kind, what)


def _check_predicate(p: Predicate) -> None:
    _need(is_path(p.path), "InvalidIdentifier", p.path)
    _need(p.op in OPERATORS, "InvalidOperation", p.op)
    if p.op in ("is_null", "not_null"):
        _need(p.value is None and not p.values, "InvalidOperation", "a null test takes no literal")
    elif p.op in ("in", "not_in"):
        _need(p.value is None, "InvalidOperation")
        _need(p.values, "ExpectedLiteral")
        _need(len({tag(v) for v in p.values}) == 1, "InvalidLiteral", "a list holds one type")
    else:
        _need(not p.values, "InvalidOperation")
        _need(p.value is not None, "ExpectedLiteral")
        if p.op in ("like", "not_like"):
            _need(tag(p.value) == "text", "InvalidLiteral", "like takes text")


def _check_fields(fields: tuple[tuple[str, Scalar], ...]) -> None:
    for path, value in fields:
        _need(is_path(path), "InvalidIdentifier", path)
        tag(value)


def validate(request: Request) -> Request:
    """The request itself, or IrError."""
    match request:
        case Emit():
            _need(is_identifier(request.source), "InvalidIdentifier", request.source)
            for p in request.where:
                _check_predicate(p)
            _need(request.fields, "ExpectedField")
            for name in request.fields:
                _need(is_path(name), "InvalidIdentifier", name)
            if request.navigate:
                _need(is_identifier(request.navigate.edge) and is_identifier(request.navigate.alias), "InvalidIdentifier")
        case Observe():
            _need(request.upload_id and request.object_id and request.media_type and request.observed_at and request.origin, "ExpectedField")
            _need(request.modality in MODALITIES, "InvalidModality")
        case ReadPayload():
            _need(request.evidence_id, "InvalidOperation")
        case InsertDocument():
            _need(request.collection and request.id, "ExpectedField")
            _need(is_identifier(request.collection), "InvalidIdentifier", request.collection)
            _check_fields(request.fields)
        case AddNode():
            _need(request.graph and request.id, "ExpectedField")
            _need(is_identifier(request.graph), "InvalidIdentifier", request.graph)
            _check_fields(request.fields)
        case AddEdge():
            _need(request.graph and request.source and request.label and request.target, "ExpectedField")
            _need(is_identifier(request.graph) and is_identifier(request.label), "InvalidIdentifier")
        case PutKv():
            _need(request.collection and request.key, "ExpectedField")
            _need(is_identifier(request.collection), "InvalidIdentifier", request.collection)
            tag(request.item)
    return request
