"""Predicates as columns: typed ones over declared columns, tagged ones over cells."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.errors import BindError
from quern.plans.request import COMPARISONS, Predicate, tag

from .cells import MEMBER
from .like import like

_COMPARE = {"eq": Column.__eq__, "neq": Column.__ne__, "lt": Column.__lt__, "lte": Column.__le__, "gt": Column.__gt__, "gte": Column.__ge__}
_KINDS = {T.LongType: "int", T.IntegerType: "int", T.ShortType: "int", T.StringType: "text", T.BooleanType: "bool"}
_SPARK = {"int": "bigint", "text": "string", "bool": "boolean"}


def kind_of(data_type: T.DataType) -> str | None:
    """int, text or bool; None for a type that no literal has."""
    return _KINDS.get(type(data_type))


def _lit(value) -> Column:
    return F.lit(value).cast(_SPARK[tag(value)])


def check_typed(p: Predicate, data_type: T.DataType) -> None:
    """BindError unless a column of that type can be tested so; before anything runs."""
    kind = kind_of(data_type)
    if p.op in ("is_null", "not_null"):
        return
    if p.op in ("like", "not_like"):
        if kind != "text":
            raise BindError("TypeMismatch", p.path)
        return
    literals = p.values or (p.value,)
    if kind is None or any(tag(v) != kind for v in literals):
        raise BindError("TypeMismatch", p.path)
    if kind == "bool" and p.op in COMPARISONS and p.op != "eq":
        raise BindError("NonComparableColumn", p.path)


def typed(p: Predicate, value: Column) -> Column:
    """A checked predicate over a declared column; null matches null tests only."""
    if p.op in _COMPARE:
        return _COMPARE[p.op](value, _lit(p.value))
    if p.op == "is_null":
        return value.isNull()
    if p.op == "not_null":
        return value.isNotNull()
    if p.op in ("in", "not_in"):
        found = value.isin(*[_lit(v) for v in p.values])
        return found if p.op == "in" else ~found
    found = like(value, p.value)
    return found if p.op == "like" else ~found


def tagged(p: Predicate, value: Column, strict_types: bool = False) -> Column:
    """A predicate over a cell. Another type than the literal's never matches, but `not in` and
    `not like` do match it unless strict_types holds."""
    if p.op in ("is_null", "not_null"):
        return typed(p, value)
    kind = tag(p.values[0] if p.values else p.value)
    same, own = value["t"] == F.lit(kind), value[MEMBER[kind]]
    if p.op in ("not_in", "not_like") and not strict_types:
        return value.isNotNull() & (~same | typed(p, own))
    return same & typed(p, own)


def declared(p: Predicate, kind: str | None, value: Column | None, strict_types: bool = False) -> Column:
    """What `tagged` says of a cell, for a column of one type, or for a path that the rows don't have (None)."""
    if kind is None:
        return F.lit(p.op == "is_null")
    if p.op in ("is_null", "not_null") or tag(p.values[0] if p.values else p.value) == kind:
        return typed(p, value)
    return value.isNotNull() if p.op in ("not_in", "not_like") and not strict_types else F.lit(False)


def all_of(columns: list[Column]) -> Column:
    return reduce(and_, columns, F.lit(True))


def any_of(groups: list[list[Column]]) -> Column:
    """OR of groups whose members are ANDed; no group matches nothing."""
    return reduce(or_, [all_of(g) for g in groups], F.lit(False))
