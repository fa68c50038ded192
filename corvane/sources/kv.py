"""Namespaced key-value log: batches of puts and deletes, read at any version.

The log is rows (namespace, key, value, seq, expiry, deleted); a batch is one folder and has one sequence number, the
version of its commit. A read takes what is visible at its sequence, the newest row of each key, and then drops deleted and
expired keys. `now` is taken once for each read. Keys order bytewise.
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import CorvaneError, InvalidValue, SerializationFailure
from .store import Manifest, Store

SCHEMA = "namespace string, key string, value string, seq long, expiry long, deleted boolean"
#: Batches after which they are folded to one sorted folder, and such folders after which the whole log is.
FOLD_BATCHES, FOLD_FOLDERS = 32, 8
# Limits of a batch.
MAX_OPS, MAX_VALUE = 10_000, 10 * 1024 * 1024
SCAN_DEFAULT, SCAN_MAX = 1000, 10_000
_NAMESPACE = re.compile(r"[A-Za-z0-9\-_.:]*")


def newest(log: DataFrame, seq: int | None = None, now: int | None = None, namespace: bool = True) -> DataFrame:
    """The visible rows of a log: newest version of each key at seq, without deleted and expired ones."""
    seen = log if seq is None else log.where(F.col("seq") <= seq)
    keys = ["namespace", "key"] if namespace else ["key"]
    picked = seen.groupBy(*keys).agg(F.max_by(F.struct("value", "expiry", "deleted", "seq"), "seq").alias("r"))
    now = int(time.time()) if now is None else now
    alive = (~F.col("r.deleted")) & ((F.col("r.expiry") <= 0) | (F.col("r.expiry") > now))
    return picked.where(alive).select(*keys, "r.value", "r.seq", "r.expiry")


class _Outpaced(CorvaneError):
    """Another writer has folded the same folders."""


def meets(namespace: str, low: str | None = None, high: str | None = None):
    """A check for commits: they fail if one since their base wrote a key of the namespace from low up to high."""

    def check(m: Manifest) -> None:
        keys = m.wrote.get("kv", {}).get(namespace, ())
        if keys is None or any((low is None or k >= low) and (high is None or k <= high) for k in keys):
            raise SerializationFailure(f"could not serialize access: namespace {namespace!r} changed in version {m.version}")

    return check


class Batch:
    """Puts and deletes that become visible together; the last operation on a key counts."""

    def __init__(self):
        self.ops: dict[str, tuple[str | None, int]] = {}
        self.n = 0

    def put(self, key: str, value: str, ttl: int = 0) -> "Batch":
        if value is None:
            raise InvalidValue(f"put of {key!r} without a value")
        if len(value.encode()) > MAX_VALUE:
            raise InvalidValue(f"the value of {key!r} is larger than {MAX_VALUE} bytes")
        return self._add(key, (value, int(time.time()) + ttl if ttl > 0 else 0))

    def delete(self, key: str) -> "Batch":
        return self._add(key, (None, 0))

    def _add(self, key: str, what: tuple[str | None, int]) -> "Batch":
        self.n += 1
        if self.n > MAX_OPS:
            raise InvalidValue(f"a batch has at most {MAX_OPS} operations")
        self.ops[key] = what
        return self


class KeyValue:
    def __init__(self, store: Store, namespace: str = ""):
        if not _NAMESPACE.fullmatch(namespace):
            raise InvalidValue(f"invalid namespace {namespace!r}")
        self.store, self.namespace = store, namespace

    def scoped(self, namespace: str) -> "KeyValue":
        return KeyValue(self.store, namespace)

    # Reads.

    def log(self, version: int | None = None, folders: list[dict] | None = None) -> DataFrame:
        """All rows of a version. A batch's rows carry seq 0 on disk: its sequence number stands in the manifest, as only
        the commit knows it, and is looked up by the folder's name."""
        spark = self.store.spark
        folders = self.store.manifest(version).kv if folders is None else folders
        if not folders:
            return spark.createDataFrame([], SCHEMA)
        rows = spark.read.schema(SCHEMA).parquet(*[f"{self.store.root}/{s['path']}" for s in folders])
        # One entry for each batch not folded yet, a bounded number.
        known = F.create_map(*[x for s in folders if s["seq"] is not None for x in (F.lit(s["path"].split("/")[-1]), F.lit(s["seq"]))]) if any(s["seq"] is not None for s in folders) else None
        if known is None:
            return rows
        folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
        return rows.withColumn("seq", F.coalesce(F.try_element_at(known, folder), F.col("seq")))

    def frame(self, low: str | None = None, high: str | None = None, version: int | None = None, inclusive: bool = False, prefix: str | None = None) -> DataFrame:
        """key, value, seq, expiry of keys from low to high (excluded unless inclusive); bounds reach the scan."""
        log = self.log(version).where(F.col("namespace") == self.namespace)
        if low is not None:
            log = log.where(F.col("key") >= low)
        if high is not None:
            log = log.where(F.col("key") <= high if inclusive else F.col("key") < high)
        if prefix:
            log = log.where(F.col("key").startswith(prefix))
        return newest(log, namespace=False)

    def get(self, key: str, version: int | None = None) -> str | None:
        row = self.frame(key, key, version, inclusive=True).first()
        return row["value"] if row else None

    def scan(self, start: str, end: str, limit: int | None = None, version: int | None = None) -> list[tuple[str, str]]:
        """Pairs in key order, end excluded."""
        return self._pairs(self.frame(start, end, version), limit)

    def scan_prefix(self, prefix: str, limit: int | None = None, version: int | None = None) -> list[tuple[str, str]]:
        return self._pairs(self.frame(version=version, prefix=prefix), limit)

    def scan_all(self, limit: int | None = None, version: int | None = None) -> list[tuple[str, str]]:
        return self._pairs(self.frame(version=version), limit)

    def page(self, start: str, end: str, limit: int = SCAN_DEFAULT) -> list[tuple[str, str]]:
        if not 0 < limit <= SCAN_MAX:
            raise InvalidValue(f"limit must be from 1 to {SCAN_MAX}")
        return self.scan(start, end, limit)

    @staticmethod
    def _pairs(df: DataFrame, limit: int | None) -> list[tuple[str, str]]:
        df = df.select("key", "value").orderBy("key")
        return [(r[0], r[1]) for r in (df.limit(limit) if limit is not None else df).toLocalIterator()]

    # Writes.

    def put(self, key: str, value: str) -> int:
        return self.write_batch(Batch().put(key, value))

    def put_with_ttl(self, key: str, value: str, ttl: int) -> int:
        return self.write_batch(Batch().put(key, value, ttl))

    def delete(self, key: str) -> int:
        return self.write_batch(Batch().delete(key))

    def delete_range(self, low: str, high: str) -> int:
        """Deletes the keys from low to high, both included, in one commit, and says how many there were. The keys stay on
        the executors; if another commit writes to the range meanwhile, it is looked up again."""
        while True:
            base = self.store.latest()
            found = self.frame(low, high, base, inclusive=True)
            n = found.count()
            if not n:
                return 0
            gone = found.select(F.lit(self.namespace).alias("namespace"), "key", F.lit(None).cast("string").alias("value"), F.lit(0).cast("long").alias("seq"), F.lit(0).cast("long").alias("expiry"), F.lit(True).alias("deleted"))
            try:
                self.append(gone, None, base, meets(self.namespace, low, high))
                return n
            except SerializationFailure:
                continue

    def write_batch(self, batch: Batch, base: int | None = None, check=None) -> int:
        """The batch's sequence number."""
        if not batch.ops:
            return self.store.latest()
        rows = [(self.namespace, k, v, 0, e, v is None) for k, (v, e) in batch.ops.items()]
        return self.append(self.store.spark.createDataFrame(rows, SCHEMA).coalesce(1), sorted(batch.ops), base, check)

    def append(self, rows: DataFrame, keys: list[str] | None = None, base: int | None = None, check=None) -> int:
        """rows in SCHEMA as one batch; their seq is set by the commit. keys: what they write, None if too many to list."""
        segment = self.store.write(rows, "kv")
        wrote = {"kv": {self.namespace: keys}}
        base = self.store.latest() if base is None else base

        def change(m: Manifest) -> None:
            m.kv.append(segment | {"seq": m.version})

        version = self.store.commit(base, change, wrote, check)
        self._fold(version)
        return version

    def _fold(self, version: int) -> None:
        """Keeps the log short by itself. What another writer folds at the same time is left to it."""
        folders = self.store.manifest(version).kv
        try:
            if sum(s["seq"] is None for s in folders) >= FOLD_FOLDERS:
                self.compact()
            elif sum(s["seq"] is not None for s in folders) >= FOLD_BATCHES:
                self.compact(batches_only=True)
        except _Outpaced:
            pass

    def compact(self, batches_only: bool = False) -> int:
        """One sorted folder for all namespaces: of the whole log its newest rows, without deleted and expired keys; or of
        the batches alone their newest rows, where deletions stay, as they hide rows of older folders."""
        base = self.store.latest()
        before = [s for s in self.store.manifest(base).kv if s["seq"] is not None or not batches_only]
        if batches_only:
            picked = self.log(base, before).groupBy("namespace", "key").agg(F.max_by(F.struct("value", "seq", "expiry", "deleted"), "seq").alias("r"))
            rows = picked.select("namespace", "key", "r.value", "r.seq", "r.expiry", "r.deleted")
        else:
            rows = newest(self.log(base)).select("namespace", "key", "value", "seq", "expiry", F.lit(False).alias("deleted"))
        segment = self.store.write(rows.repartitionByRange("namespace", "key").sortWithinPartitions("namespace", "key"), "kv")

        def change(m: Manifest) -> None:
            if any(s not in m.kv for s in before):
                raise _Outpaced("the log was compacted by another writer")
            m.kv = [*(s for s in m.kv if s["seq"] is None and s not in before), segment | {"seq": None}, *(s for s in m.kv if s["seq"] is not None and s not in before)]

        return self.store.commit(base, change, {})

    def snapshot(self) -> "Snapshot":
        return Snapshot(self)

    def count(self, **bounds) -> int:
        return self.frame(**bounds).count()

    def put_many(self, pairs: Iterable[tuple[str, str]]) -> int:
        out, batch = self.store.latest(), Batch()
        for k, v in pairs:
            if batch.n == MAX_OPS:
                out, batch = self.write_batch(batch), Batch()
            batch.put(k, v)
        return self.write_batch(batch) if batch.n else out


class Snapshot:
    """A pinned version: reads repeat, and garbage collection keeps it until close()."""

    def __init__(self, kv: KeyValue):
        self.kv = kv
        self.version, self.pinned = kv.store.pin_latest()

    def get(self, key: str) -> str | None:
        return self.kv.get(key, self.version)

    def scan(self, start: str, end: str, limit: int | None = None) -> list[tuple[str, str]]:
        return self.kv.scan(start, end, limit, self.version)

    def scan_prefix(self, prefix: str, limit: int | None = None) -> list[tuple[str, str]]:
        return self.kv.scan_prefix(prefix, limit, self.version)

    def close(self) -> None:
        self.kv.store.unpin(self.pinned)

    def __enter__(self) -> "Snapshot":
        return self

    def __exit__(self, *_) -> None:
        self.close()
