"""Corvane: a strict SQL dialect, versioned tables and a key-value API on Spark DataFrames."""

from .embedded import Embedded
from .errors import CorvaneError, DuplicateTable, SerializationFailure, SqlSyntaxError, UndefinedTable
from .session import Result, Session

__all__ = ["CorvaneError", "DuplicateTable", "Embedded", "Result", "SerializationFailure", "Session", "SqlSyntaxError", "UndefinedTable"]
