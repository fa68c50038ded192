"""Comparisons, patterns and aggregates with the dialect's semantics as Spark columns."""

from __future__ import annotations

import datetime
import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidValue
from ..plans import ast as a
from .types import LONG, as_number, as_text, as_timestamp

_UNKNOWN = "boolean"


def unknown() -> Column:
    return F.lit(None).cast(_UNKNOWN)


def _apply(c: Column, op: str, v: Column) -> Column:
    return {"=": c == v, "<>": c != v, "<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v}[op]


def _decided(c: Column, truth: bool) -> Column:
    """truth for every value, unknown for NULL."""
    return F.when(c.isNotNull(), F.lit(truth))


def compare(c: Column, kind: str, op: str, value: a.Value) -> Column:
    """A column against a literal, which takes the column's type; the column is never cast, so filters push down."""
    if isinstance(value, a.Null):
        return unknown()
    if op == "like":
        return like(c, kind, as_text(value))
    if kind in ("TEXT", "JSON"):
        return _apply(c, op, F.lit(as_text(value)))
    if kind == "BOOLEAN":
        text = as_text(value)
        if text in ("true", "false"):
            return _apply(c, op, F.lit(text == "true"))
        return _other(c, op, kind, value)
    if kind == "TIMESTAMP":
        at = as_timestamp(as_text(value))
        return _apply(c, op, F.lit(at).cast("timestamp_ntz")) if isinstance(at, datetime.datetime) else _other(c, op, kind, value)
    n = as_number(value)
    if n is None:
        return _other(c, op, kind, value)
    if kind == "FLOAT":
        return _apply(c, op, F.lit(float(n)))
    return _integer(c, op, n, kind)


def _other(c: Column, op: str, kind: str, value: a.Value) -> Column:
    """A literal outside the column's type equals no value; an order between them is an error."""
    if op in ("=", "<>"):
        return _decided(c, op == "<>")
    raise InvalidValue(f"cannot order a column of type {kind} against {as_text(value)!r}")


def _integer(c: Column, op: str, n: int | float, kind: str) -> Column:
    if isinstance(n, float) and n != math.floor(n):
        if op in ("=", "<>"):
            return _decided(c, op == "<>")
        # c < 1.5 is c <= 1, c > 1.5 is c >= 2.
        op, n = ("<=", math.floor(n)) if op in ("<", "<=") else (">=", math.ceil(n))
    n = int(n)
    low, high = LONG if kind == "INTEGER" else (-(10**38) + 1, 10**38 - 1)
    if not low <= n <= high:
        if op in ("=", "<>"):
            return _decided(c, op == "<>")
        return _decided(c, (n > high) == (op in ("<", "<=")))
    return _apply(c, op, F.lit(n) if kind == "INTEGER" else F.lit(str(n)).cast("decimal(38,0)"))


def like(c: Column, kind: str, pattern: str) -> Column:
    """% is any run and _ any one character other than a line feed; every other character is itself."""
    text = c if kind in ("TEXT", "JSON") else c.cast("string")
    parts = [{"%": ".*", "_": "."}.get(ch) or re.escape(ch) for ch in pattern]
    out = text.rlike("(?d)\\A" + "".join(parts) + "\\z")
    head = re.match("[^%_]*", pattern)[0]
    # The fixed start of a pattern also reaches the scan.
    return text.startswith(head) & out if head and kind in ("TEXT", "JSON") else out


def in_list(c: Column, kind: str, values: tuple) -> Column:
    """TRUE on a match, else UNKNOWN if the list has a NULL, else FALSE; the list is plain literals where types allow."""
    nulls = any(isinstance(v, a.Null) for v in values)
    some = [v for v in values if not isinstance(v, a.Null)]
    out = F.lit(False)
    plain, rest = [], []
    for v in some:
        n = as_number(v) if kind in ("INTEGER", "FLOAT") else None
        if kind in ("TEXT", "JSON"):
            plain.append(as_text(v))
        elif kind == "FLOAT" and n is not None:
            plain.append(float(n))
        elif kind == "INTEGER" and n is not None and n == int(n) and LONG[0] <= n <= LONG[1]:
            plain.append(int(n))
        else:
            rest.append(v)
    if plain:
        out = c.isin(plain)
    for v in rest:
        out = out | compare(c, kind, "=", v)
    if not some:
        return unknown() if nulls else _decided(c, False)
    return out | unknown() if nulls else out


def aggregate(function: str, c: Column | None, kind: str | None) -> tuple[Column, str]:
    """A Spark aggregate and the dialect's type of its result."""
    if function == "count":
        return F.count(F.lit(1) if c is None else c), "INTEGER"
    if function in ("min", "max"):
        return (F.min if function == "min" else F.max)(c), kind
    if kind not in ("INTEGER", "WIDE", "FLOAT"):
        raise InvalidValue(f"{function} needs a numeric column, not {kind}")
    if kind == "FLOAT":
        return (F.sum if function == "sum" else F.avg)(c.cast("double")), "FLOAT"
    # Exact at 38 digits, and an error beyond.
    total = F.sum(c.cast("decimal(38,0)"))
    if function == "sum":
        return total, "WIDE"
    # Quotient and remainder apart, so that no digit of a large sum is lost: 15 fraction digits, 6 for a WIDE column.
    n = F.nullif(F.count(c), F.lit(0)).cast("decimal(18,0)")
    rest = total % n
    whole = ((total - rest) / n).cast("decimal(32,0)" if kind == "WIDE" else "decimal(20,0)")
    return (whole + F.round(rest / n, 6 if kind == "WIDE" else 15)).cast("decimal(38,6)" if kind == "WIDE" else "decimal(36,15)"), "FLOAT"


def order(c: Column, descending: bool) -> Column:
    """NULL counts as the greatest value."""
    return c.desc_nulls_first() if descending else c.asc_nulls_last()
