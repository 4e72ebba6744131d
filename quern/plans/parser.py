"""Source text to a request and back. One stage stands on a line; blank lines don't count."""

from __future__ import annotations

import re

from quern.errors import ParseError

from .request import Emit, Literal, Navigate, Predicate, is_identifier, is_path, validate

_PATH_START = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*")
_INTEGER = re.compile(r"[+-]?[0-9](?:_?[0-9])*\Z")
_BLANK = " \t"
#: Symbols of comparisons; longer ones are tried first.
SYMBOLS = {"!=": "neq", "<=": "lte", ">=": "gte", "=": "eq", "<": "lt", ">": "gt"}


def _literal(text: str) -> Literal:
    if len(text) >= 2 and text[0] == text[-1] == "'":
        return text[1:-1]
    if text in ("true", "false"):
        return text == "true"
    if _INTEGER.match(text) and -(2**63) <= int(text) < 2**63:
        return int(text)
    raise ParseError("InvalidLiteral", text)


def _quoted(text: str) -> str:
    if len(text) < 2 or text[0] != "'" or text[-1] != "'":
        raise ParseError("InvalidLiteral", text)
    return text[1:-1]


def _list(text: str) -> tuple[Literal, ...]:
    inside = text[1:-1].strip(_BLANK) if len(text) >= 2 and text[0] == "(" and text[-1] == ")" else ""
    items = [x.strip(_BLANK) for x in inside.split(",")]
    if not all(items):
        raise ParseError("ExpectedLiteral", text)
    return tuple(map(_literal, items))


def _where(body: str) -> Predicate:
    body = body.strip(_BLANK)
    if not body:
        raise ParseError("ExpectedOperator")
    m = _PATH_START.match(body)
    if m is None:
        raise ParseError("InvalidIdentifier", body)
    path, rest = m[0], body[m.end() :].strip(_BLANK)
    if rest in ("is null", "is not null"):
        return Predicate(path, "is_null" if rest == "is null" else "not_null")
    for symbol, op in SYMBOLS.items():
        if rest.startswith(symbol):
            text = rest[len(symbol) :].strip(_BLANK)
            if not text:
                raise ParseError("ExpectedLiteral")
            return Predicate(path, op, _literal(text))
    for word, op in (("not in", "not_in"), ("in", "in"), ("not like", "not_like"), ("like", "like")):
        if rest.startswith(word):
            text = rest[len(word) :].strip(_BLANK)
            return Predicate(path, op, values=_list(text)) if op.endswith("in") else Predicate(path, op, _quoted(text))
    raise ParseError("ExpectedOperator", rest)


def _navigate(body: str) -> Navigate:
    edge, found, alias = (x.strip(_BLANK) for x in body.strip(_BLANK).partition(" as "))
    if not (edge and alias):
        raise ParseError("ExpectedAlias", body)
    if not (is_identifier(edge) and is_identifier(alias)):
        raise ParseError("InvalidIdentifier", body)
    return Navigate(edge, alias)


def _emit(line: str) -> tuple[str, ...]:
    if line[-1] != "}":
        raise ParseError("ExpectedEmit")
    names = [x.strip(_BLANK) for x in line[len("| emit {") : -1].split(",")]
    if not all(names):
        raise ParseError("ExpectedField")
    for name in names:
        if not is_path(name):
            raise ParseError("InvalidIdentifier", name)
    return tuple(names)


def _limit(line: str) -> int:
    if not line.startswith("| limit "):
        raise ParseError("UnsupportedStage", line)
    text = line[len("| limit ") :].strip(_BLANK)
    if not re.match(r"\+?[0-9](?:_?[0-9])*\Z", text) or int(text) >= 2**32:
        raise ParseError("InvalidLimit", text)
    return int(text)


def parse(source: str) -> Emit:
    """The request that the text says, valid; ParseError or IrError otherwise."""
    lines = [x for x in (raw.strip(" \t\r") for raw in source.split("\n")) if x]
    if not lines:
        raise ParseError("EmptyRequest")
    first, *stages = lines
    if not first.startswith("from "):
        raise ParseError("ExpectedFrom", first)
    name = first[len("from ") :].strip(_BLANK)
    if not name:
        raise ParseError("ExpectedRelation")
    if not is_identifier(name):
        raise ParseError("InvalidIdentifier", name)
    where: list[Predicate] = []
    navigate = fields = None
    while stages and fields is None:
        line = stages.pop(0)
        if line.startswith("| where "):
            where.append(_where(line[len("| where ") :]))
        elif line.startswith("| navigate ") and navigate is None:
            navigate = _navigate(line[len("| navigate ") :])
        elif line.startswith("| emit {"):
            fields = _emit(line)
        else:
            raise ParseError("UnsupportedStage", line)
    if fields is None:
        raise ParseError("ExpectedEmit")
    limit = _limit(stages.pop(0)) if stages else None
    if stages:
        raise ParseError("UnsupportedStage", stages[0])
    return validate(Emit(name, fields, tuple(where), limit, navigate))


def render(request: Emit) -> str:
    """Source text that parses to the request; text literals can't hold line breaks, nor list members commas."""

    def literal(v: Literal) -> str:
        return str(v).lower() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else str(v)

    symbols = {op: s for s, op in SYMBOLS.items()}
    out = [f"from {request.source}"]
    for p in request.where:
        if p.op in symbols:
            tail = f"{symbols[p.op]} {literal(p.value)}"
        elif p.op in ("is_null", "not_null"):
            tail = "is null" if p.op == "is_null" else "is not null"
        elif p.values:
            tail = f"{p.op.replace('_', ' ')} ({', '.join(map(literal, p.values))})"
        else:
            tail = f"{p.op.replace('_', ' ')} {literal(p.value)}"
        out.append(f"| where {p.path} {tail}")
    if request.navigate:
        out.append(f"| navigate {request.navigate.edge} as {request.navigate.alias}")
    out.append(f"| emit {{ {', '.join(request.fields)} }}")
    if request.limit is not None:
        out.append(f"| limit {request.limit}")
    return "\n".join(out)
