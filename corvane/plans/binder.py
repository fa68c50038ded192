"""Names to columns, with the dialect's messages."""

from __future__ import annotations

from dataclasses import dataclass

from ..errors import AmbiguousColumn, UndefinedColumn
from . import ast as a


@dataclass(frozen=True)
class Bound:
    """A column in scope: where it comes from, its type, and its internal name, which is unique in the statement."""

    table: str
    name: str
    kind: str
    internal: str


class Scope:
    """The columns of one or two tables. Tables resolve without regard to case, columns by exact case."""

    def __init__(self, tables: list[tuple[str, list[tuple[str, str]], str]]):
        self.tables = [t for t, _, _ in tables]
        self.columns = [Bound(t, c, k, f"c{i}_{j}") for i, (t, cols, _) in enumerate(tables) for j, (c, k) in enumerate(cols)]
        self.keys = [next((b for b in self.columns if b.table == t and b.name == pk), None) for t, _, pk in tables]

    def of(self, table: str) -> list[Bound]:
        return [b for b in self.columns if b.table.lower() == table.lower()]

    def resolve(self, ref: a.ColumnRef) -> Bound:
        if ref.table is not None and ref.table.lower() not in [t.lower() for t in self.tables]:
            raise UndefinedColumn(f'table "{ref.table}" is not in the FROM clause of this statement')
        found = [b for b in self.columns if b.name == ref.name and (ref.table is None or b.table.lower() == ref.table.lower())]
        if not found:
            raise UndefinedColumn(f'column "{ref.shown}" does not exist')
        if len(found) > 1:
            raise AmbiguousColumn(f'column "{ref.name}" is ambiguous — it exists in tables {found[0].table} and {found[1].table}; write {found[0].table}.{ref.name}')
        return found[0]
