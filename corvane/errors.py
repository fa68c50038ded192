"""Errors, each with an SQLSTATE."""


class CorvaneError(Exception):
    sqlstate = "XX000"


class SqlSyntaxError(CorvaneError):
    sqlstate = "42601"


class UndefinedTable(CorvaneError):
    sqlstate = "42P01"


class DuplicateTable(CorvaneError):
    sqlstate = "42P07"


class UndefinedColumn(CorvaneError):
    sqlstate = "42703"


class AmbiguousColumn(CorvaneError):
    sqlstate = "42702"


class GroupingError(CorvaneError):
    sqlstate = "42803"


class InvalidValue(CorvaneError):
    sqlstate = "22P02"


class UniqueViolation(CorvaneError):
    sqlstate = "23505"


class NotNullViolation(CorvaneError):
    sqlstate = "23502"


class MissingParameter(CorvaneError):
    sqlstate = "08P01"


class SerializationFailure(CorvaneError):
    sqlstate = "40001"


class TransactionState(CorvaneError):
    sqlstate = "25000"
