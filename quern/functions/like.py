"""LIKE with % for any run, _ for one byte and backslash to escape the next byte."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pieces(pattern: str) -> list[tuple[str, str]] | None:
    """('any' | 'one' | 'is', text) in order; None if a lone backslash ends the pattern, which then never matches."""
    out: list[tuple[str, str]] = []
    at = 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            at += 1
            if at == len(pattern):
                return None
            out.append(("is", pattern[at]))
        else:
            out.append({"%": ("any", c), "_": ("one", c)}.get(c, ("is", c)))
        at += 1
    return out


def _native(parts: list[tuple[str, str]]) -> str:
    return "".join("\\" + c if kind == "is" and c in "\\%_" else c for kind, c in parts)


def _byte_regex(parts: list[tuple[str, str]]) -> str:
    """Over a string that has one character for each byte."""
    shapes = {"any": r"[\s\S]*", "one": r"[\s\S]"}
    return r"\A" + "".join(shapes.get(kind) or "".join(f"\\x{b:02x}" for b in c.encode()) for kind, c in parts) + r"\z"


def like(value: Column, pattern: str) -> Column:
    """Null for null. Without _ it is the engine's own LIKE, which reaches the scan."""
    parts = pieces(pattern)
    if parts is None:
        return F.when(value.isNotNull(), F.lit(False))
    if all(kind != "one" for kind, _ in parts):
        return value.like(_native(parts))
    return F.decode(F.encode(value, "UTF-8"), "ISO-8859-1").rlike(_byte_regex(parts))
