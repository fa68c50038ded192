"""Column types of the dialect and their Spark types."""

from __future__ import annotations

import datetime
import decimal
import re

from pyspark.sql import types as T

from ..errors import InvalidValue, SqlSyntaxError
from ..plans import ast as a

# Accepted spellings of the six types.
SPELLINGS = {
    "INTEGER": ("INT", "INTEGER", "BIGINT", "SMALLINT"),
    "FLOAT": ("FLOAT", "DOUBLE", "REAL", "NUMERIC", "DECIMAL"),
    "TEXT": ("TEXT", "VARCHAR", "STRING", "CHAR"),
    "BOOLEAN": ("BOOL", "BOOLEAN"),
    "TIMESTAMP": ("TIMESTAMP", "DATETIME", "DATE"),
    "JSON": ("JSON", "JSONB"),
}
#: WIDE is INTEGER with up to 38 digits; only declared explicitly.
SPARK = {"INTEGER": T.LongType(), "WIDE": T.DecimalType(38, 0), "FLOAT": T.DoubleType(), "TEXT": T.StringType(), "BOOLEAN": T.BooleanType(), "TIMESTAMP": T.TimestampNTZType(), "JSON": T.StringType()}
OID = {"INTEGER": 20, "WIDE": 20, "FLOAT": 701, "TEXT": 25, "BOOLEAN": 16, "TIMESTAMP": 1114, "JSON": 114}
LONG = (-(1 << 63), (1 << 63) - 1)


def type_name(spelling: str) -> str:
    up = spelling.upper()
    if up in ("WIDE", "HUGEINT"):
        return "WIDE"
    for name, known in SPELLINGS.items():
        if up in known:
            return name
    raise SqlSyntaxError(f"Unknown type: {spelling}")


def of_spark(kind: T.DataType) -> str:
    """The dialect's type of a column of an external table."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "INTEGER"
    if isinstance(kind, T.DecimalType):
        return "WIDE" if kind.scale == 0 else "FLOAT"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "FLOAT"
    if isinstance(kind, T.BooleanType):
        return "BOOLEAN"
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return "TIMESTAMP"
    return "TEXT"


def as_text(v: a.Value) -> str:
    """A literal's text: 1.0 is 1, TRUE is true."""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return str(int(v)) if v == int(v) and abs(v) < 1e16 else repr(v)
    return str(v)


def as_number(v: a.Value) -> int | float | None:
    """A literal as an exact integer or a finite float, if it is one."""
    if isinstance(v, bool) or isinstance(v, a.Null):
        return None
    if isinstance(v, (int, float)):
        return v
    if re.fullmatch(r"[+-]?\d+", v):
        return int(v)
    try:
        f = float(v)
    except ValueError:
        return None
    return f if f - f == 0 and not re.search("[a-df-zA-DF-Z_]", v) else None


def as_timestamp(text: str) -> datetime.datetime | None:
    try:
        return datetime.datetime.fromisoformat(text).replace(tzinfo=None)
    except ValueError:
        return None


def store(v: a.Value, kind: str, column: str):
    """A literal as the Python value that a column of this type stores; values that do not conform are rejected."""
    if isinstance(v, a.Null) or v is None:
        return None
    bad = InvalidValue(f"invalid value for column {column} of type {kind}: {as_text(v)!r}")
    if kind in ("TEXT", "JSON"):
        return as_text(v)
    if kind == "BOOLEAN":
        text = as_text(v).lower()
        if text not in ("true", "false"):
            raise bad
        return text == "true"
    if kind == "TIMESTAMP":
        got = as_timestamp(as_text(v))
        if got is None:
            raise bad
        return got
    n = as_number(v)
    if n is None:
        raise bad
    if kind == "FLOAT":
        return float(n)
    if isinstance(n, float):
        if n != int(n):
            raise bad
        n = int(n)
    if kind == "INTEGER" and not LONG[0] <= n <= LONG[1]:
        raise bad
    if kind == "WIDE":
        if abs(n) >= 10**38:
            raise bad
        return decimal.Decimal(n)
    return n
