"""Typed cells of collections without a schema, and how cells read as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.plans.request import Scalar, tag

#: A scalar with its type tag; an absent or null field is a null struct.
CELL = T.StructType([T.StructField("t", T.StringType()), T.StructField("i", T.LongType()), T.StructField("s", T.StringType()), T.StructField("b", T.BooleanType())])
FIELDS = T.MapType(T.StringType(), CELL)
#: Which member of a cell holds a type's values.
MEMBER = {"int": "i", "text": "s", "bool": "b"}
_SQL = CELL.simpleString()


def cell(kind: str, value: Column) -> Column:
    """A column's values as cells of one type; null stays null."""
    parts = [value.cast(t).alias(m) if MEMBER[kind] == m else F.lit(None).cast(t).alias(m) for m, t in (("i", "bigint"), ("s", "string"), ("b", "boolean"))]
    return F.when(value.isNotNull(), F.struct(F.lit(kind).alias("t"), *parts)).otherwise(F.lit(None).cast(_SQL))


def cell_value(value: Scalar) -> dict | None:
    """A Python scalar as a row of CELL."""
    kind = tag(value)
    return None if kind == "null" else {"t": kind} | {m: value if MEMBER[kind] == m else None for m in "isb"}


def fields_map(pairs: dict[str, Column]) -> Column:
    """A map of paths to cells; null cells are left out."""
    return F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k in pairs]), F.array(*pairs.values())), lambda _, v: v.isNotNull())


def first_wins(fields: tuple[tuple[str, Scalar], ...]) -> dict[str, Scalar]:
    """Of several values for one path the first counts."""
    out: dict[str, Scalar] = {}
    for path, value in fields:
        out.setdefault(path, value)
    return out


def render_text(value: Column, kind: T.DataType) -> Column:
    """A column as result text: null stays null, vectors as [1,2.5]."""
    if kind == CELL:
        return F.coalesce(value["i"].cast("string"), value["s"], value["b"].cast("string"))
    if isinstance(kind, T.ArrayType):
        one = lambda v: F.regexp_replace(v.cast("string"), r"\.0$", "")
        return F.when(value.isNotNull(), F.concat(F.lit("["), F.array_join(F.transform(value, one), ","), F.lit("]")))
    return value.cast("string")
