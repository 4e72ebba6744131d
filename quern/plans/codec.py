"""Requests as canonical bytes: big endian, counted strings, one byte sequence for each request."""

from __future__ import annotations

import struct

from quern.errors import IrError

from . import request as rq

# fixed values: the byte form's version, tags of operations, of predicates' operators (from 1) and of scalars
VERSION = 6
OPERATIONS = {1: rq.Emit, 2: rq.Observe, 3: rq.ReadPayload, 4: rq.InsertDocument, 5: rq.AddNode, 6: rq.AddEdge, 7: rq.PutKv}
OPERATOR_TAGS = ("eq", "neq", "lt", "gt", "lte", "gte", "is_null", "not_null", "in", "not_in", "like", "not_like")
NULL, INT, TEXT, BOOL = range(4)


class _Writer:
    def __init__(self):
        self.parts: list[bytes] = []

    def put(self, kind: str, value: int) -> None:
        self.parts.append(struct.pack(f">{kind}", value))

    def count(self, n: int, kind: str = "H") -> None:
        if n >= 1 << (8 * struct.calcsize(kind)):
            raise IrError("StringTooLarge", str(n))
        self.put(kind, n)

    def text(self, value: str) -> None:
        raw = value.encode()
        self.count(len(raw))
        self.parts.append(raw)

    def scalar(self, value: rq.Scalar) -> None:
        kind = ("null", "int", "text", "bool").index(rq.tag(value))
        self.put("B", kind)
        if kind == INT:
            self.put("q", value)
        elif kind == TEXT:
            self.text(value)
        elif kind == BOOL:
            self.put("B", value)

    def fields(self, pairs) -> None:
        self.count(len(pairs))
        for path, value in pairs:
            self.text(path)
            self.scalar(value)


class _Reader:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def bytes(self, n: int) -> bytes:
        if len(self.raw) - self.at < n:
            raise IrError("InvalidFormat", "too short")
        self.at += n
        return self.raw[self.at - n : self.at]

    def get(self, kind: str) -> int:
        return struct.unpack(f">{kind}", self.bytes(struct.calcsize(f">{kind}")))[0]

    def flag(self) -> bool:
        value = self.get("B")
        if value > 1:
            raise IrError("InvalidFormat", "not a flag")
        return bool(value)

    def text(self) -> str:
        try:
            return self.bytes(self.get("H")).decode()
        except UnicodeDecodeError:
            raise IrError("InvalidFormat", "not UTF-8") from None

    def scalar(self, null: bool = True) -> rq.Scalar:
        kind = self.get("B")
        if kind == NULL and null:
            return None
        if kind == INT:
            return self.get("q")
        if kind == TEXT:
            return self.text()
        if kind == BOOL:
            return self.flag()
        raise IrError("InvalidFormat", "no such type")

    def fields(self) -> tuple:
        return tuple((self.text(), self.scalar()) for _ in range(self.get("H")))


def encode(request: rq.Request) -> bytes:
    rq.validate(request)
    w = _Writer()
    w.put("H", VERSION)
    w.put("Q", getattr(request, "revision", rq.MODEL_REVISION))
    w.put("B", next(t for t, kind in OPERATIONS.items() if isinstance(request, kind)))
    match request:
        case rq.Emit():
            w.text(request.source)
            w.count(len(request.where), "B")
            for p in request.where:
                w.text(p.path)
                w.put("B", OPERATOR_TAGS.index(p.op) + 1)
                if p.op in ("in", "not_in"):
                    w.count(len(p.values))
                    for v in p.values:
                        w.scalar(v)
                elif p.op not in ("is_null", "not_null"):
                    w.scalar(p.value)
            w.count(len(request.fields))
            for name in request.fields:
                w.text(name)
            w.put("B", request.limit is not None)
            if request.limit is not None:
                w.put("I", request.limit)
            w.put("B", request.navigate is not None)
            if request.navigate:
                w.text(request.navigate.edge)
                w.text(request.navigate.alias)
        case rq.Observe():
            w.put("Q", request.upload_id)
            w.text(request.object_id)
            w.put("B", request.modality)
            for value in (request.media_type, request.observed_at, request.origin):
                w.text(value)
        case rq.ReadPayload():
            w.put("Q", request.evidence_id)
        case rq.InsertDocument() | rq.AddNode():
            w.text(request.collection if isinstance(request, rq.InsertDocument) else request.graph)
            w.text(request.id)
            w.fields(request.fields)
        case rq.AddEdge():
            for value in (request.graph, request.source, request.label, request.target):
                w.text(value)
        case rq.PutKv():
            w.text(request.collection)
            w.text(request.key)
            w.scalar(request.item)
    return b"".join(w.parts)


def _predicate(r: _Reader) -> rq.Predicate:
    path, n = r.text(), r.get("B")
    if not 1 <= n <= len(OPERATOR_TAGS):
        raise IrError("InvalidFormat", "no such operator")
    op = OPERATOR_TAGS[n - 1]
    if op in ("is_null", "not_null"):
        return rq.Predicate(path, op)
    if op in ("in", "not_in"):
        return rq.Predicate(path, op, values=tuple(r.scalar(null=False) for _ in range(r.get("H"))))
    return rq.Predicate(path, op, r.scalar(null=False))


def decode(raw: bytes) -> rq.Request:
    r = _Reader(raw)
    if (version := r.get("H")) != VERSION:
        raise IrError("UnsupportedVersion", str(version))
    revision, operation = r.get("Q"), r.get("B")
    kind = OPERATIONS.get(operation)
    if kind is None:
        raise IrError("InvalidOperation", str(operation))
    if kind is rq.Emit:
        source = r.text()
        where = tuple(_predicate(r) for _ in range(r.get("B")))
        fields = tuple(r.text() for _ in range(r.get("H")))
        limit = r.get("I") if r.flag() else None
        navigate = rq.Navigate(r.text(), r.text()) if r.flag() else None
        request = rq.Emit(source, fields, where, limit, navigate, revision)
    elif kind is rq.Observe:
        request = rq.Observe(r.get("Q"), r.text(), r.get("B"), r.text(), r.text(), r.text())
    elif kind is rq.ReadPayload:
        request = rq.ReadPayload(r.get("Q"))
    elif kind in (rq.InsertDocument, rq.AddNode):
        request = kind(r.text(), r.text(), r.fields())
    elif kind is rq.AddEdge:
        request = rq.AddEdge(r.text(), r.text(), r.text(), r.text())
    else:
        request = rq.PutKv(r.text(), r.text(), r.scalar())
    if r.at != len(raw):
        raise IrError("InvalidFormat", "bytes left over")
    return rq.validate(request)
