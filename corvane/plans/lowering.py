"""Select statements to DataFrames. Catalyst does the planning; this fixes where the dialect differs from Spark."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import GroupingError, SqlSyntaxError
from ..functions import columns as C
from ..operators import ranking, sets
from . import ast as a
from .binder import Bound, Scope


#: Names of columns made on the way differ between all statements of a process.
_FRESH = count(1)


@dataclass
class Table:
    """A table at one version: its name, columns with types, primary key, and rows."""

    name: str
    columns: list[tuple[str, str]]
    primary_key: str
    rows: DataFrame


#: Gives a table by name, at the statement's snapshot.
Resolver = Callable[[str], Table]


class Lowering:
    def __init__(self, resolve: Resolver):
        self.resolve = resolve

    def query(self, q: a.Query) -> DataFrame:
        """Rows with the dialect's column names (names may repeat)."""
        if isinstance(q, a.SetOp):
            return sets.combine(q.op, q.all, self.query(q.left), self.query(q.right))
        return self.select(q)

    # Predicates.

    def filter(self, df: DataFrame, p: a.Predicate | None, look: Callable[[a.Operand], tuple[Column, str]]) -> DataFrame:
        """Conjuncts one by one; IN (SELECT) becomes a semi or null-aware anti join where it stands alone."""
        if p is None:
            return df
        if isinstance(p, a.And):
            return self.filter(self.filter(df, p.left, look), p.right, look)
        if isinstance(p, a.InSelect):
            return self.in_select(df, p, look, False)
        if isinstance(p, a.Not) and isinstance(p.inner, a.InSelect):
            return self.in_select(df, p.inner, look, True)
        df, condition = self.condition(df, p, look)
        return df.where(condition)

    def in_select(self, df: DataFrame, p: a.InSelect, look, negated: bool) -> DataFrame:
        """A semi join, or for NOT IN an anti join after two facts about the subquery: whether it has rows, and a NULL.

        Spark's own null-aware anti join would broadcast the subquery whatever its size.
        """
        inner, value = self.subquery(p)
        column = look(p.left)[0]
        if not negated:
            return df.join(inner, column == F.col(value), "left_semi")
        facts = inner.agg(F.count(F.lit(1)).alias("n"), F.count(value).alias("some")).first()
        if facts["n"] == 0:
            return df
        if facts["some"] < facts["n"]:
            return df.where(F.lit(False))
        return df.where(column.isNotNull()).join(inner, column == F.col(value), "left_anti")

    def subquery(self, p: a.InSelect) -> tuple[DataFrame, str]:
        """The first column of the inner query, under a name of its own."""
        inner = self.query(p.select)
        value = f"_v{next(_FRESH)}"
        return inner.toDF(*[f"{value}{'_' * i}" for i in range(len(inner.columns))]).select(value), value

    def condition(self, df: DataFrame, p: a.Predicate, look) -> tuple[DataFrame, Column]:
        """A predicate as a column. IN (SELECT) under OR or NOT joins the distinct values and keeps three-valued logic."""
        if isinstance(p, a.And) or isinstance(p, a.Or):
            df, left = self.condition(df, p.left, look)
            df, right = self.condition(df, p.right, look)
            return df, left & right if isinstance(p, a.And) else left | right
        if isinstance(p, a.Not):
            df, inner = self.condition(df, p.inner, look)
            return df, ~inner
        if isinstance(p, a.InSelect):
            inner, value = self.subquery(p)
            hit, column = f"{value}_hit", look(p.left)[0]
            values = inner.where(F.col(value).isNotNull()).distinct().withColumn(hit, F.lit(True))
            facts = inner.agg(F.count(F.lit(1)).alias("n"), F.count(value).alias("some")).first()
            df = df.join(values, column == F.col(value), "left").drop(value)
            if facts["n"] == 0:
                return df, F.lit(False)
            missed = C.unknown() if facts["some"] < facts["n"] else F.lit(False)
            return df, F.when(column.isNull(), C.unknown()).otherwise(F.when(F.col(hit), F.lit(True)).otherwise(missed))
        column, kind = look(p.left)
        if isinstance(p, a.IsNull):
            return df, column.isNotNull() if p.negated else column.isNull()
        if isinstance(p, a.InList):
            return df, C.in_list(column, kind, p.values)
        return df, C.compare(column, kind, p.op, p.value)

    # Select.

    def source(self, s: a.Select) -> tuple[DataFrame, Scope]:
        tables = [self.resolve(s.table)] + ([self.resolve(s.join.table)] if s.join else [])
        if len(tables) == 2 and tables[0].name.lower() == tables[1].name.lower():
            raise SqlSyntaxError("a table cannot be joined with itself: there are no aliases")
        scope = Scope([(t.name, t.columns, t.primary_key) for t in tables])
        frames = []
        for t in tables:
            mine = scope.of(t.name)
            frames.append(t.rows.select(*[F.col(f"`{b.name}`").alias(b.internal) for b in mine]))
        if not s.join:
            return frames[0], scope
        x, y = scope.resolve(s.join.left), scope.resolve(s.join.right)
        if x.table == y.table:
            raise SqlSyntaxError("ON must name a column of each table")
        if x.table != tables[0].name:
            x, y = y, x
        left, right = F.col(x.internal), F.col(y.internal)
        numeric = ("INTEGER", "WIDE", "FLOAT")
        if x.kind != y.kind and not (x.kind in numeric and y.kind in numeric):
            left, right = left.cast("string"), right.cast("string")
        return frames[0].join(frames[1], left == right, s.join.kind), scope

    def select(self, s: a.Select) -> DataFrame:
        df, scope = self.source(s)

        def look(o: a.Operand) -> tuple[Column, str]:
            if isinstance(o, a.Aggregate):
                raise GroupingError(f"aggregate {o.shown} is not allowed in WHERE")
            b = scope.resolve(o)
            return F.col(b.internal), b.kind

        self.check(s, scope)
        df = self.filter(df, s.where, look)
        keys_text = [F.col(k.internal).cast("string") for k in scope.keys if k]
        tie = [C.order(k, False) for k in keys_text]
        grouped = bool(s.group) or self.aggregates(s)
        if grouped:
            df, places = self.aggregate(df, s, scope)
            tie = keys_text = []
        else:
            places = {("column", b.table, b.name): (b.internal, b.kind) for b in scope.columns}

        def place(o: a.Operand) -> tuple[str, str]:
            if isinstance(o, a.Aggregate):
                return places[("aggregate", o.function, scope.resolve(o.column).internal if o.column else "*")]
            b = scope.resolve(o)
            return places[("column", b.table, b.name)]

        def output(o: a.Operand) -> tuple[Column, str]:
            name, kind = place(o)
            return F.col(name), kind

        df = self.filter(df, s.having, output)
        # Windows see all filtered rows, before ORDER BY and LIMIT.
        made: dict[a.Ranking, str] = {}
        for item in s.items:
            if isinstance(item, a.Ranking) and item not in made:
                key, by = place(item.order)[0], [place(p)[0] for p in item.partition]
                made[item] = f"w{len(made)}"
                ties = keys_text or [F.col(c).cast("string") for c in df.columns if c[0] in "gp"]
                if by:
                    df = ranking.partitioned_rank(df, item.function, by, key, item.descending, ties, made[item])
                else:
                    df = ranking.global_rank(df, item.function, key, item.descending, ties, made[item])
        limited = s.limit is not None or s.offset is not None
        if s.order:
            keys = [C.order(output(o.by)[0], o.descending) for o in s.order]
            df = df.orderBy(*keys, *(tie if limited else []))
        elif limited:
            df = df.orderBy(*(tie or [F.col(c).cast("string") for c in df.columns]))
        if s.offset is not None:
            df = df.offset(int(s.offset))
        if s.limit is not None:
            df = df.limit(int(s.limit))
        internal, shown = [], []
        for item in s.items:
            if isinstance(item, a.Star):
                for b in scope.columns:
                    internal.append(place(a.ColumnRef(b.name, b.table))[0])
                    shown.append(b.name)
            elif isinstance(item, a.Ranking):
                internal.append(made[item])
                shown.append(item.shown)
            else:
                internal.append(place(item)[0])
                shown.append(item.shown if isinstance(item, a.Aggregate) else item.name)
        return df.select(*[F.col(c).alias(f"o{i}") for i, c in enumerate(internal)]).toDF(*shown)

    def aggregates(self, s: a.Select) -> bool:
        return any(isinstance(i, a.Aggregate) for i in s.items) or any(isinstance(o.by, a.Aggregate) for o in s.order) or any(isinstance(o, a.Aggregate) for o in operands(s.having))

    def aggregate(self, df: DataFrame, s: a.Select, scope: Scope) -> tuple[DataFrame, dict]:
        keys: list[Bound] = []
        for g in s.group:
            b = scope.resolve(g)
            if b not in keys:
                keys.append(b)
        places = {("column", b.table, b.name): (f"g{i}", b.kind) for i, b in enumerate(keys)}
        wanted: list[a.Operand] = [o for i in s.items for o in ([a.ColumnRef(b.name, b.table) for b in scope.columns] if isinstance(i, a.Star) else [i.order, *i.partition] if isinstance(i, a.Ranking) else [i])]
        wanted += [o.by for o in s.order] + list(operands(s.having))
        first = F.struct(*[F.col(k.internal).cast("string") for k in scope.keys if k])
        made: list[Column] = []
        for o in wanted:
            if isinstance(o, a.Aggregate):
                b = scope.resolve(o.column) if o.column else None
                at = ("aggregate", o.function, b.internal if b else "*")
                if at not in places:
                    column, kind = C.aggregate(o.function, F.col(b.internal) if b else None, b.kind if b else None)
                    places[at] = (f"p{len(made)}", kind)
                    made.append(column.alias(places[at][0]))
            else:
                b = scope.resolve(o)
                at = ("column", b.table, b.name)
                if at not in places:
                    places[at] = (f"p{len(made)}", b.kind)
                    # A column beside the keys is that of the group's first row by the text of its key, NULL without groups.
                    column = F.min_by(F.col(b.internal), first) if s.group else F.max(F.lit(None)).cast(df.schema[b.internal].dataType)
                    made.append(column.alias(places[at][0]))
        if not keys:
            return df.agg(*made), places
        named = df.groupBy(*[F.col(b.internal).alias(f"g{i}") for i, b in enumerate(keys)])
        return (named.agg(*made) if made else named.agg(F.count(F.lit(1)).alias("_n"))), places

    def check(self, s: a.Select, scope: Scope) -> None:
        """Every name before anything runs, so that a faulty statement fails even with LIMIT 0."""
        for p, allowed in ((s.where, False), (s.having, True)):
            for o in operands(p):
                if isinstance(o, a.Aggregate):
                    if not allowed:
                        raise GroupingError(f"aggregate {o.shown} is not allowed in WHERE")
                    if o.column:
                        scope.resolve(o.column)
                else:
                    b = scope.resolve(o)
                    if allowed and b not in [scope.resolve(g) for g in s.group]:
                        raise GroupingError(f'column "{o.shown}" must appear in the GROUP BY clause')
        for i in s.items:
            for o in (i.order, *i.partition) if isinstance(i, a.Ranking) else (i,) if isinstance(i, a.ColumnRef) else (i.column,) if isinstance(i, a.Aggregate) and i.column else ():
                scope.resolve(o)
        for o in s.order:
            target = o.by.column if isinstance(o.by, a.Aggregate) else o.by
            if target:
                scope.resolve(target)


def operands(p: a.Predicate | None):
    if p is None:
        return
    if isinstance(p, (a.And, a.Or)):
        yield from operands(p.left)
        yield from operands(p.right)
    elif isinstance(p, a.Not):
        yield from operands(p.inner)
    else:
        yield p.left
