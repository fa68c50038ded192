"""Transactions: a pinned version, staged changes that only they see, and a conflict check at commit.

A table that was read or changed by predicate conflicts with any later commit to it; a table that only got inserts
conflicts if a later commit wrote one of the same keys, which a join decides. Key-value reads are remembered as keys and
ranges and hold against the keys that later batches wrote. More may abort than must, never less.
"""

from __future__ import annotations

import copy
import time
from functools import reduce

from pyspark.sql import DataFrame

from .errors import SerializationFailure, TransactionState
from .sources.kv import Batch
from .sources.store import FOLD_AFTER, Manifest, Store

#: Seconds after which a transaction can no longer commit.
TIMEOUT = 30.0


class Transaction:
    def __init__(self, store: Store, timeout: float | None = TIMEOUT):
        self.store, self.base = store, store.latest()
        self.tables: dict = copy.deepcopy(store.manifest(self.base).tables)
        self.reads: set[str] = set()
        # Table -> segments staged; None for a table created or dropped here.
        self.staged: dict[str, list[dict] | None] = {}
        self.kv: dict[str, Batch] = {}
        self.kv_keys: set[tuple[str, str]] = set()
        self.kv_ranges: list[tuple[str, str | None, str | None]] = []
        self.meta = None
        self.saved: list[tuple[str, tuple]] = []
        self.until = time.monotonic() + timeout if timeout else None
        self.open = True

    # Key-value operations.

    def get(self, key: str, namespace: str = "") -> str | None:
        from .sources.kv import KeyValue

        batch = self.kv.get(namespace)
        if batch and key in batch.ops:
            return batch.ops[key][0]
        self.kv_keys.add((namespace, key))
        return KeyValue(self.store, namespace).get(key, self.base)

    def scan(self, low: str | None, high: str | None, namespace: str = "") -> list[tuple[str, str]]:
        from .sources.kv import KeyValue

        self.kv_ranges.append((namespace, low, high))
        rows = dict((r["key"], r["value"]) for r in KeyValue(self.store, namespace).frame(low, high, self.base).toLocalIterator())
        for k, (v, _) in (self.kv[namespace].ops if namespace in self.kv else {}).items():
            if (low is None or k >= low) and (high is None or k < high):
                rows.pop(k, None)
                if v is not None:
                    rows[k] = v
        return sorted(rows.items())

    def set(self, key: str, value: str, ttl: int = 0, namespace: str = "") -> None:
        self.kv.setdefault(namespace, Batch()).put(key, value, ttl)

    def delete(self, key: str, namespace: str = "") -> None:
        self.kv.setdefault(namespace, Batch()).delete(key)

    # Tables.

    def stage(self, table: str, segment: dict) -> None:
        self.tables[table]["segments"].append(segment)
        if self.staged.get(table, []) is not None:
            self.staged.setdefault(table, []).append(segment)

    def create(self, table: str, entry: dict) -> None:
        self.tables[table] = entry
        self.staged[table] = None

    def drop(self, table: str) -> None:
        del self.tables[table]
        self.staged[table] = None

    # Savepoints.

    def _state(self) -> tuple:
        return copy.deepcopy((self.tables, self.reads, self.staged, self.kv, self.kv_keys, self.kv_ranges))

    def savepoint(self, name: str) -> None:
        self.saved.append((name, self._state()))

    def _find(self, name: str) -> int:
        for k in range(len(self.saved) - 1, -1, -1):
            if self.saved[k][0] == name:
                return k
        raise TransactionState(f"savepoint {name} does not exist")

    def rollback_to(self, name: str) -> None:
        """Back to the savepoint, which is gone afterwards, like those made after it. What was read stays read."""
        k = self._find(name)
        reads, keys, ranges = self.reads, self.kv_keys, self.kv_ranges
        self.tables, _, self.staged, self.kv, _, _ = self.saved[k][1]
        self.reads, self.kv_keys, self.kv_ranges = reads, keys, ranges
        del self.saved[k:]

    def release(self, name: str) -> None:
        del self.saved[self._find(name) :]

    # End.

    def _conflict(self, m: Manifest) -> None:
        def fail(what: str):
            raise SerializationFailure(f"could not serialize access: {what} changed in version {m.version}")

        for table, theirs in m.wrote.get("tables", {}).items():
            if table in self.reads:
                fail(f"table {table}")
            if table in self.staged:
                mine = self.staged[table]
                if mine is None or theirs is None or self._meet(table, mine, theirs):
                    fail(f"table {table}")
        for namespace, keys in m.wrote.get("kv", {}).items():
            mine = set(self.kv[namespace].ops) if namespace in self.kv else set()
            read = {k for n, k in self.kv_keys if n == namespace}
            ranges = [(a, b) for n, a, b in self.kv_ranges if n == namespace]
            if keys is None:
                if mine or read or ranges:
                    fail(f"namespace {namespace!r}")
            elif (mine | read) & set(keys) or any((a is None or k >= a) and (b is None or k < b) for a, b in ranges for k in keys):
                fail(f"a key of namespace {namespace!r}")

    def _meet(self, table: str, mine: list[dict], theirs: list[dict]) -> bool:
        """Whether two lists of segments share a key."""
        entry = self.tables[table]
        pk = entry["primary_key"]

        def keys(segments: list[dict]) -> DataFrame:
            schema = self.store.schema(entry)
            return reduce(DataFrame.unionByName, [self.store.spark.read.schema(schema).parquet(f"{self.store.root}/{s['path']}").select(f"`{pk}`") for s in segments])

        return bool(mine and theirs) and not keys(mine).join(keys(theirs), pk, "left_semi").isEmpty()

    def commit(self) -> int:
        self._end()
        if self.until and time.monotonic() > self.until:
            raise TransactionState("the transaction timed out")
        if not self.staged and not self.kv:
            return self.base
        segments = {}
        for namespace, batch in self.kv.items():
            rows = [(namespace, k, v, 0, e, v is None) for k, (v, e) in batch.ops.items()]
            from .sources.kv import SCHEMA

            segments[namespace] = self.store.write(self.store.spark.createDataFrame(rows, SCHEMA).coalesce(1), "kv")
        wrote = {"tables": self.staged, "kv": {n: sorted(b.ops) for n, b in self.kv.items()}}

        def change(m: Manifest) -> None:
            for table, mine in self.staged.items():
                if mine is None:
                    if table in self.tables:
                        m.tables[table] = self.tables[table]
                    else:
                        m.tables.pop(table, None)
                else:
                    m.tables[table]["segments"] += mine
            m.kv += [s | {"seq": m.version} for s in segments.values()]

        version = self.store.commit(self.base, change, wrote, self._conflict)
        if self.kv:
            from .sources.kv import KeyValue

            KeyValue(self.store)._fold(version)
        for table in [t for t, s in self.staged.items() if s]:
            now = self.store.manifest(version).tables.get(table)
            if now and sum(s["kind"] == "changes" for s in now["segments"]) > FOLD_AFTER:
                try:
                    self.store.fold(table)
                except SerializationFailure:
                    pass
        return version

    def rollback(self) -> None:
        self._end()

    def _end(self) -> None:
        if not self.open:
            raise TransactionState("the transaction has ended")
        self.open = False

