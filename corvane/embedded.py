"""One object for a store: key-value calls, SQL, snapshots and maintenance."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .indexes import IndexManager
from .prepared import QueryEngine
from .session import Result, Session
from .sources.kv import Batch, KeyValue, Snapshot


class Embedded:
    """open_dir() a folder; scoped() gives the same store under a namespace. SQL is not namespaced."""

    def __init__(self, session: Session, namespace: str = ""):
        self.session, self.keys = session, session.kv(namespace)
        self.closed = False

    @classmethod
    def open_dir(cls, spark: SparkSession, path: str) -> "Embedded":
        return cls(Session(spark, path))

    def scoped(self, namespace: str) -> "Embedded":
        return Embedded(self.session, namespace)

    def _kv(self) -> KeyValue:
        if self.closed:
            raise RuntimeError("the store is closed")
        return self.keys

    def put(self, key: str, value: str) -> int:
        return self._kv().put(key, value)

    def put_with_ttl(self, key: str, value: str, seconds: int) -> int:
        return self._kv().put_with_ttl(key, value, seconds)

    def get(self, key: str) -> str | None:
        return self._kv().get(key)

    def get_at(self, key: str, snapshot: Snapshot) -> str | None:
        return self._kv().get(key, snapshot.version)

    def delete(self, key: str) -> int:
        return self._kv().delete(key)

    def write_batch(self, batch: Batch) -> int:
        return self._kv().write_batch(batch)

    def scan(self, start: str, end: str, limit: int | None = None) -> list[tuple[str, str]]:
        return self._kv().scan(start, end, limit)

    def scan_prefix(self, prefix: str, limit: int | None = None) -> list[tuple[str, str]]:
        return self._kv().scan_prefix(prefix, limit)

    def scan_all(self, limit: int | None = None) -> list[tuple[str, str]]:
        return self._kv().scan_all(limit)

    def snapshot(self) -> Snapshot:
        return self._kv().snapshot()

    def execute_sql(self, text: str, values: list | tuple = ()) -> Result:
        self._kv()
        return self.session.sql(text, values)

    def queries(self) -> QueryEngine:
        return QueryEngine(self._kv())

    def indexes(self) -> IndexManager:
        return IndexManager(self._kv())

    def compact(self) -> None:
        self._kv()
        self.session.compact()

    def collect_garbage(self) -> int:
        return self._kv().store.collect_garbage()

    def sync(self) -> None:
        """Every commit is durable when its call returns."""
        self._kv()

    def create_backup(self, to: str) -> int:
        self._kv()
        return self.session.create_backup(to)

    @classmethod
    def restore_backup(cls, spark: SparkSession, at: str, to: str) -> "Embedded":
        return cls(Session.restore(spark, at, to))

    def stats(self) -> dict:
        return self._kv().store.stats()

    def close(self) -> None:
        self.closed = True
