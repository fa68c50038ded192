"""The public API: SQL, tables, transactions and the key-value store of one folder."""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import explain
from .errors import DuplicateTable, InvalidValue, MissingParameter, NotNullViolation, SqlSyntaxError, TransactionState, UndefinedColumn, UniqueViolation
from .functions import columns as C
from .functions.types import SPARK, as_text, store
from .plans import ast as a
from .plans import params
from .plans.lowering import Lowering, Table
from .plans.parser import parse
from .sources import backup, workspace
from .sources.catalog import External, missing
from .sources.kv import KeyValue
from .sources.store import DELETED, Store
from .txn import Transaction


@dataclass
class Result:
    """What a statement gives: rows, a number of changed rows, or a message."""

    kind: str  # rows, modified, ok
    df: DataFrame | None = None
    count: int = 0
    command: str = ""
    message: str = ""
    _rows: Iterator[Row] | None = None

    @property
    def columns(self) -> list[str]:
        return self.df.columns if self.df is not None else []

    def fetch(self, n: int) -> list[tuple]:
        """The next n rows; a row's cells are typed values."""
        if self._rows is None:
            self._rows = self.df.toLocalIterator() if self.df is not None else iter(())
        out = []
        for row in self._rows:
            out.append(tuple(row))
            if len(out) == n:
                break
        return out

    def collect(self) -> list[tuple]:
        return [tuple(r) for r in self.df.collect()] if self.df is not None else []

    def rendered(self) -> list[list[str]]:
        """All rows as text: NULL is NULL, numbers without trailing zeros."""
        return [[render(v) for v in r] for r in self.collect()]


def render(v: Any) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, decimal.Decimal):
        text = format(v, "f")
        return text.rstrip("0").rstrip(".") if "." in text else text
    if isinstance(v, (bool, float)):
        return as_text(v)
    return str(v)


class Session:
    """One user's view of a store: at most one open transaction, external tables of its own."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        # Column names are exact; tables are looked up here, not by Spark.
        spark.conf.set("spark.sql.caseSensitive", "true")
        self._path, self._store = path, None
        self.external = External(spark)
        self.txn: Transaction | None = None
        self.failed = False

    @property
    def store(self) -> Store:
        """The folder of managed tables, made on first use (a new one in the workspace if no path was given)."""
        if self._store is None:
            self._store = Store(self.spark, self._path or workspace.folder(self.spark))
        return self._store

    # Registration and key-value access.

    def register_parquet(self, name: str, path: str, primary_key: str | None = None) -> None:
        self.external.register_parquet(name, path, primary_key)

    def register(self, name: str, df: DataFrame, primary_key: str | None = None) -> None:
        self.external.register(name, df, primary_key)

    def kv(self, namespace: str = "") -> KeyValue:
        return KeyValue(self.store, namespace)

    # Transactions.

    def begin(self, timeout: float | None = 30.0) -> Transaction:
        if self.txn:
            raise TransactionState("there is already a transaction in progress")
        self.txn, self.failed = Transaction(self.store, timeout), False
        return self.txn

    def commit(self) -> int:
        txn, self.txn = self._current(), None
        if self.failed:
            self.failed = False
            txn.rollback()
            raise TransactionState("the transaction was rolled back after an error")
        return txn.commit()

    def rollback(self) -> None:
        txn, self.txn, self.failed = self._current(), None, False
        txn.rollback()

    def _current(self) -> Transaction:
        if not self.txn:
            raise TransactionState("there is no transaction in progress")
        return self.txn

    # Statements.

    def sql(self, text: str, values: list | tuple = ()) -> Result:
        return self.execute(parse(text), values)

    def execute(self, statement: a.Statement, values: list | tuple = ()) -> Result:
        statement = params.bind(statement, list(values))
        if (n := params.unbound(statement)) is not None:
            raise MissingParameter(f"no value specified for parameter ${n}")
        if isinstance(statement, a.Transaction):
            return self._transaction(statement)
        if self.failed:
            raise TransactionState("current transaction is aborted, commands ignored until end of transaction block")
        try:
            return self._statement(statement)
        except Exception:
            self.failed = self.txn is not None
            raise

    def _transaction(self, s: a.Transaction) -> Result:
        if s.action == "begin":
            self.begin()
        elif s.action == "commit":
            self.commit()
        elif s.action == "rollback":
            self.rollback()
        elif s.action in ("savepoint", "rollback_to", "release"):
            getattr(self._current(), s.action)(s.name)
            if s.action == "rollback_to":
                self.failed = False
        if s.chain:
            self.begin()
        return Result("ok", message=s.action.upper().replace("_", " "), command=s.action.upper())

    def _statement(self, s: a.Statement) -> Result:
        if isinstance(s, (a.Select, a.SetOp)):
            return Result("rows", self.dataframe(s), command="SELECT")
        if isinstance(s, a.ShowTables):
            names = sorted({*self._tables(), *self.external.tables})
            return Result("rows", self.spark.createDataFrame([(n,) for n in names], "table_name string"), command="SHOW")
        if isinstance(s, a.Explain):
            return self._explain(s)
        made = self.txn or Transaction(self.store, None)
        if isinstance(s, a.CreateTable):
            out = self._create(s, made)
        elif isinstance(s, a.DropTable):
            out = self._drop(s, made)
        else:
            out = {a.Insert: self._insert, a.Update: self._update, a.Delete: self._delete}[type(s)](s, made)
        if made is not self.txn:
            made.commit()
        return out

    def dataframe(self, query: a.Query | str) -> DataFrame:
        """A query as a lazy DataFrame over the statement's snapshot."""
        if isinstance(query, str):
            query = parse(query)
            if not isinstance(query, (a.Select, a.SetOp)):
                raise SqlSyntaxError("not a query")
        version = None
        cache: dict[str, Table] = {}

        def resolve(name: str) -> Table:
            nonlocal version
            key = name.lower()
            if key not in cache:
                if key in self.external.tables and key not in self._known():
                    cache[key] = self.external.tables[key]
                else:
                    if version is None and not self.txn:
                        version = self.store.latest()
                    cache[key] = self._managed(key, name, version)
            return cache[key]

        return Lowering(resolve).query(query)

    def table_at(self, name: str, version: int) -> DataFrame:
        """A managed table at an earlier version."""
        entry = self.store.manifest(version).tables.get(name.lower())
        if not entry:
            raise missing(name)
        return self.store.rows(entry)

    def _known(self) -> dict:
        return self._tables()

    def _tables(self) -> dict:
        if self.txn:
            return self.txn.tables
        return self.store.manifest().tables if self._store or self._path else {}

    def _managed(self, key: str, name: str, version: int | None) -> Table:
        entry = (self.txn.tables if self.txn else self.store.manifest(version).tables).get(key)
        if not entry:
            raise missing(name)
        if self.txn:
            self.txn.reads.add(key)
        return Table(entry["name"], [tuple(c) for c in entry["columns"]], entry["primary_key"], self.store.rows(entry))

    # Tables.

    def _create(self, s: a.CreateTable, txn: Transaction) -> Result:
        key = s.name.lower()
        if key in txn.tables or key in self.external.tables:
            if s.if_not_exists:
                return Result("ok", message=f"Table '{s.name}' already exists", command="CREATE TABLE")
            raise DuplicateTable(f"Table '{s.name}' already exists")
        primary = next((c.name for c in s.columns if c.primary_key), s.columns[0].name)
        flags = {c.name: {"not_null": c.not_null, "default": None if isinstance(c.default, a.Null) else c.default} for c in s.columns}
        txn.create(key, {"name": s.name, "columns": [[c.name, c.type] for c in s.columns], "primary_key": primary, "declared": flags, "segments": []})
        return Result("ok", message=f"Table '{s.name}' created", command="CREATE TABLE")

    def _drop(self, s: a.DropTable, txn: Transaction) -> Result:
        key = s.name.lower()
        if key not in txn.tables:
            if s.if_exists:
                return Result("ok", message=f"Table '{s.name}' does not exist", command="DROP TABLE")
            raise missing(s.name)
        txn.drop(key)
        return Result("ok", message=f"Table '{s.name}' dropped", command="DROP TABLE")

    def _entry(self, name: str, txn: Transaction) -> dict:
        key = name.lower()
        if key not in txn.tables:
            if key in self.external.tables:
                raise InvalidValue(f"Table '{name}' is external and read-only")
            raise missing(name)
        return txn.tables[key]

    @staticmethod
    def _column(entry: dict, name: str) -> tuple[str, str]:
        for c, k in entry["columns"]:
            if c.lower() == name.lower():
                return c, k
        raise UndefinedColumn(f'column "{name}" does not exist')

    def _insert(self, s: a.Insert, txn: Transaction) -> Result:
        entry = self._entry(s.table, txn)
        columns = [self._column(entry, c) for c in s.columns] or [tuple(c) for c in entry["columns"]]
        if len({c for c, _ in columns}) < len(columns):
            raise SqlSyntaxError("a column is named twice")
        pk, names = entry["primary_key"], [c for c, _ in entry["columns"]]
        rows, seen = [], set()
        for values in s.rows:
            if len(values) != len(columns):
                raise SqlSyntaxError(f"INSERT has {len(values)} values for {len(columns)} columns")
            row = {c: store(v, k, c) for (c, k), v in zip(columns, values)}
            if row.get(pk) is None or row[pk] == "":
                raise NotNullViolation(f"primary key {pk} has no value")
            if row[pk] in seen:
                raise UniqueViolation(f"duplicate key {render(row[pk])} in table {entry['name']}")
            seen.add(row[pk])
            rows.append(tuple(row.get(c) for c in names))
        fresh = self.spark.createDataFrame(rows, self.store.schema(entry)).coalesce(1)
        self._unique(entry, fresh, pk, seen)
        txn.stage(s.table.lower(), self.store.write(fresh, "rows"))
        return Result("modified", count=len(rows), command="INSERT")

    def _unique(self, entry: dict, fresh: DataFrame, pk: str, keys: set | None = None) -> None:
        """The incoming keys against the table: few keys are a pushed filter, many a semi join."""
        rows = self.store.rows(entry).select(f"`{pk}`")
        if keys is not None and len(keys) <= 1000 and not isinstance(next(iter(keys), None), decimal.Decimal):
            found = rows.where(F.col(f"`{pk}`").isin(list(keys))).first()
        else:
            found = rows.join(fresh.select(F.col(f"`{pk}`").alias("_new")), F.col(f"`{pk}`") == F.col("_new"), "left_semi").first()
        if found:
            raise UniqueViolation(f"duplicate key {render(found[0])} in table {entry['name']}")

    def load(self, table: str, df: DataFrame) -> int:
        """Rows of a DataFrame into a managed table, by column name: the distributed form of INSERT."""
        txn = self.txn or Transaction(self.store, None)
        entry = self._entry(table, txn)
        pk = entry["primary_key"]
        rows = df.select(*[F.col(f"`{c}`").cast(SPARK[k]).alias(c) if c in df.columns else F.lit(None).cast(SPARK[k]).alias(c) for c, k in entry["columns"]])
        segment = self.store.write(rows, "rows")
        written = self.spark.read.schema(self.store.schema(entry)).parquet(f"{self.store.root}/{segment['path']}")
        bad = written.groupBy(F.col(f"`{pk}`").alias("k")).count().where("k is null or count > 1").first()
        if bad:
            raise NotNullViolation(f"primary key {pk} has no value") if bad["k"] is None else UniqueViolation(f"duplicate key {render(bad['k'])} in table {entry['name']}")
        if entry["segments"]:
            self._unique(entry, written, pk)
        txn.stage(table.lower(), segment)
        if txn is not self.txn:
            txn.commit()
        return written.count()

    def _target(self, name: str, where: a.Predicate | None, txn: Transaction) -> tuple[dict, DataFrame]:
        """The rows of a table that a predicate selects, under their own column names."""
        entry = self._entry(name, txn)
        txn.reads.add(name.lower())
        table = Table(entry["name"], [tuple(c) for c in entry["columns"]], entry["primary_key"], self.store.rows(entry))
        cache = {name.lower(): table}

        def resolve(other: str) -> Table:
            key = other.lower()
            if key not in cache:
                if key in self.external.tables:
                    cache[key] = self.external.tables[key]
                else:
                    e = self._entry(other, txn)
                    txn.reads.add(key)
                    cache[key] = Table(e["name"], [tuple(c) for c in e["columns"]], e["primary_key"], self.store.rows(e))
            return cache[key]

        return entry, Lowering(resolve).select(a.Select((a.Star(),), name, where=where))

    def _update(self, s: a.Update, txn: Transaction) -> Result:
        entry, rows = self._target(s.table, s.where, txn)
        pk, sets = entry["primary_key"], {}
        for name, value in s.sets:
            column, kind = self._column(entry, name)
            v = store(value, kind, column)
            if column == pk:
                raise InvalidValue(f"primary key {pk} cannot be updated")
            sets[column] = F.lit(v).cast(SPARK[kind])
        changed = rows.withColumns(sets).withColumn(DELETED, F.lit(False))
        return self._change(s.table, changed, txn, "UPDATE")

    def _delete(self, s: a.Delete, txn: Transaction) -> Result:
        entry, rows = self._target(s.table, s.where, txn)
        pk = entry["primary_key"]
        gone = rows.select(*[F.col(f"`{c}`") if c == pk else F.lit(None).cast(SPARK[k]).alias(c) for c, k in entry["columns"]], F.lit(True).alias(DELETED))
        return self._change(s.table, gone, txn, "DELETE")

    def _change(self, table: str, rows: DataFrame, txn: Transaction, command: str) -> Result:
        """Only changed rows are written; readers mask the old ones by key."""
        segment = self.store.write(rows, "changes")
        n = self.spark.read.schema(rows.schema).parquet(f"{self.store.root}/{segment['path']}").count()
        if n:
            txn.stage(table.lower(), segment)
        return Result("modified", count=n, command=command)

    def _explain(self, s: a.Explain) -> Result:
        if isinstance(s.statement, (a.Select, a.SetOp)):
            df = self.dataframe(s.statement)
            lines = explain.analyzed(df) if s.analyze else explain.planned(df)
        else:
            lines = [repr(s.statement)]
        return Result("rows", self.spark.createDataFrame([(x,) for x in lines], T.StructType([T.StructField("QUERY PLAN", T.StringType())])), command="EXPLAIN")

    # Maintenance.

    def compact(self) -> None:
        """Folds every table and the key-value log."""
        for name in list(self.store.manifest().tables):
            self.store.fold(name)
        if self.store.manifest().kv:
            self.kv().compact()

    def stats(self) -> dict:
        return self.store.stats()

    def create_backup(self, to: str) -> int:
        return backup.create(self.store, to)

    @classmethod
    def restore(cls, spark: SparkSession, at: str, to: str) -> "Session":
        backup.restore(spark, at, to)
        return cls(spark, to)


#: Kept for callers that build predicates on their own.
compare = C.compare
