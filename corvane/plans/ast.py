"""Statements and predicates as data."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Union


@dataclass(frozen=True)
class Null:
    pass


@dataclass(frozen=True)
class Param:
    number: int


#: str, int, float, bool, Null or Param.
Value = Union[str, int, float, bool, Null, Param]


@dataclass(frozen=True)
class ColumnRef:
    name: str
    table: str | None = None

    @property
    def shown(self) -> str:
        return f"{self.table}.{self.name}" if self.table else self.name


@dataclass(frozen=True)
class Star:
    pass


@dataclass(frozen=True)
class Aggregate:
    function: str  # count, sum, avg, min, max
    column: ColumnRef | None  # None: *

    @property
    def shown(self) -> str:
        return f"{self.function}({self.column.name if self.column else '*'})"


@dataclass(frozen=True)
class Ranking:
    function: str  # row_number, rank, dense_rank
    order: ColumnRef
    descending: bool = False
    partition: tuple[ColumnRef, ...] = ()

    @property
    def shown(self) -> str:
        return self.function


Item = Union[Star, ColumnRef, Aggregate, Ranking]
Operand = Union[ColumnRef, Aggregate]


@dataclass(frozen=True)
class Compare:
    left: Operand
    op: str  # = <> < > <= >= like
    value: Value


@dataclass(frozen=True)
class IsNull:
    left: Operand
    negated: bool


@dataclass(frozen=True)
class InList:
    left: Operand
    values: tuple[Value, ...]


@dataclass(frozen=True)
class InSelect:
    left: Operand
    select: "Query"


@dataclass(frozen=True)
class And:
    left: "Predicate"
    right: "Predicate"


@dataclass(frozen=True)
class Or:
    left: "Predicate"
    right: "Predicate"


@dataclass(frozen=True)
class Not:
    inner: "Predicate"


Predicate = Union[Compare, IsNull, InList, InSelect, And, Or, Not]


@dataclass(frozen=True)
class Join:
    kind: str  # inner, left, right
    table: str
    left: ColumnRef
    right: ColumnRef


@dataclass(frozen=True)
class OrderItem:
    by: Operand
    descending: bool = False


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...]
    table: str
    join: Join | None = None
    where: Predicate | None = None
    group: tuple[ColumnRef, ...] = ()
    having: Predicate | None = None
    order: tuple[OrderItem, ...] = ()
    limit: Value | None = None
    offset: Value | None = None


@dataclass(frozen=True)
class SetOp:
    op: str  # union, intersect, except
    all: bool
    left: Select
    right: "Query"


Query = Union[Select, SetOp]


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str
    primary_key: bool = False
    not_null: bool = False
    default: Value | None = None


@dataclass(frozen=True)
class CreateTable:
    name: str
    columns: tuple[ColumnDef, ...]
    if_not_exists: bool = False


@dataclass(frozen=True)
class DropTable:
    name: str
    if_exists: bool = False


@dataclass(frozen=True)
class ShowTables:
    pass


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...]
    rows: tuple[tuple[Value, ...], ...]


@dataclass(frozen=True)
class Update:
    table: str
    sets: tuple[tuple[str, Value], ...]
    where: Predicate | None = None


@dataclass(frozen=True)
class Delete:
    table: str
    where: Predicate | None = None


@dataclass(frozen=True)
class Explain:
    statement: "Statement"
    analyze: bool = False


@dataclass(frozen=True)
class Transaction:
    action: str  # begin, commit, rollback, set, savepoint, rollback_to, release
    name: str = ""
    chain: bool = False
    extra: tuple = field(default=())


Statement = Union[CreateTable, DropTable, ShowTables, Insert, Select, SetOp, Update, Delete, Explain, Transaction]
