"""Versions of all tables and of the key-value log, as manifests over immutable Parquet folders.

Data files are written first, each commit to a folder of its own; then one new manifest, manifests/<version>.json, makes
the commit visible in one step, whatever the number of tables. A manifest is complete: it lists for each table its
columns and segments in order. A segment of rows adds rows; a segment of changes replaces or deletes rows by primary
key. Readers hold a version and list nothing else, so a statement sees one snapshot.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SerializationFailure
from ..functions.types import SPARK
from .files import Files

DELETED = "_deleted"
#: Change segments of a table after which a commit folds it.
FOLD_AFTER = 8
#: Seconds for which files that nothing names are kept: a running commit may be about to name them.
SAFE_AGE_S = 6 * 3600.0
_LOCK = threading.RLock()


@dataclass
class Manifest:
    version: int
    tables: dict = field(default_factory=dict)  # lower name -> name, columns, primary_key, segments
    kv: list = field(default_factory=list)  # segments of the key-value log
    meta: dict = field(default_factory=dict)  # indexes, migrations
    # What this commit wrote and the version that it was made from, for conflict checks.
    wrote: dict = field(default_factory=dict)
    at: float = 0.0

    def dumps(self) -> str:
        return json.dumps(self.__dict__, sort_keys=True)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Files(spark, self.root)
        self.held: dict[int, Manifest] = {}
        self.pins: dict[str, int] = {}
        if self.latest() is None:
            self.files.fs.mkdirs(self.files.path("manifests"))
            self.files.put_new(self._name(0), Manifest(0).dumps())

    @staticmethod
    def _name(version: int) -> str:
        return f"manifests/{version:020d}.json"

    def latest(self) -> int | None:
        names = [n for n in self.files.list("manifests") if n.endswith(".json")]
        return int(names[-1][:-5]) if names else None

    def manifest(self, version: int | None = None) -> Manifest:
        v = self.latest() if version is None else version
        if v not in self.held:
            self.held[v] = Manifest(**json.loads(self.files.read(self._name(v))))
        return self.held[v]

    # Rows.

    def schema(self, table: dict, changes: bool = False) -> T.StructType:
        out = T.StructType([T.StructField(c, SPARK[k]) for c, k in table["columns"]])
        return out.add(DELETED, T.BooleanType()) if changes else out

    def rows(self, table: dict) -> DataFrame:
        """The table's rows: runs of row segments are one scan; a change segment masks what stands before it by key."""
        schema, out, run = self.schema(table), None, []
        pk = f"`{table['primary_key']}`"

        def close() -> None:
            nonlocal out, run
            if run:
                part = self.spark.read.schema(schema).parquet(*run)
                out, run = part if out is None else out.unionByName(part), []

        for s in table["segments"]:
            path = f"{self.root}/{s['path']}"
            if s["kind"] == "rows":
                run.append(path)
                continue
            close()
            changed = self.spark.read.schema(self.schema(table, True)).parquet(path)
            kept = changed.where(f"not {DELETED}").drop(DELETED)
            out = kept if out is None else out.join(changed.select(F.col(pk).alias("_changed")), F.col(pk) == F.col("_changed"), "left_anti").unionByName(kept)
        close()
        return out if out is not None else self.spark.createDataFrame([], schema)

    def write(self, df: DataFrame, kind: str) -> dict:
        """Rows to a new folder; nothing refers to it until a commit does."""
        path = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{path}")
        return {"path": path, "kind": kind}

    # Commits.

    def commit(self, base: int, change, wrote: dict, check=None) -> int:
        """change(manifest dict copy) applied to the newest version, after check() of every commit since base."""
        seen = base
        while True:
            with _LOCK:
                now = self.latest()
                for v in range(seen + 1, now + 1):
                    if check:
                        check(self.manifest(v))
                seen = now
                old = self.manifest(now)
                new = Manifest(now + 1, json.loads(json.dumps(old.tables)), list(old.kv), json.loads(json.dumps(old.meta)), wrote, time.time())
                change(new)
                if self.files.put_new(self._name(now + 1), new.dumps()):
                    return now + 1
            time.sleep(0.02)

    # Maintenance.

    def fold(self, name: str) -> bool:
        """Rewrites a table as one row segment."""
        base = self.latest()
        table = self.manifest(base).tables[name]
        if len(table["segments"]) < 2 and all(s["kind"] == "rows" for s in table["segments"]):
            return False
        segment = self.write(self.rows(table), "rows")
        before = table["segments"]

        def change(m: Manifest) -> None:
            now = m.tables.get(name)
            if not now or now["segments"][: len(before)] != before:
                raise SerializationFailure(f"table {name} was replaced while it was folded")
            now["segments"] = [segment, *now["segments"][len(before) :]]

        self.commit(base, change, {})
        return True

    def pin(self, version: int) -> str:
        name = f"pins/{uuid.uuid4().hex}"
        self.files.put(name, str(version))
        self.pins[name] = version
        return name

    def pin_latest(self) -> tuple[int, str]:
        """The newest version and its pin; a version that was collected before the pin stood is tried again."""
        while True:
            version = self.latest()
            pinned = self.pin(version)
            if self.files.exists(self._name(version)):
                return version, pinned
            self.unpin(pinned)

    def unpin(self, name: str) -> None:
        self.pins.pop(name, None)
        self.files.delete(name)

    def collect_garbage(self, keep_versions: int = 1, older_than_s: float = SAFE_AGE_S) -> int:
        """Deletes manifests below the newest few and the pinned ones, then data folders that no manifest names.

        Nothing younger than older_than_s goes: a running commit may be about to name a folder, a snapshot to pin a version.
        """
        newest = self.latest()
        pinned = {int(self.files.read(f"pins/{n}")) for n in self.files.list("pins")}
        versions = [int(n[:-5]) for n in self.files.list("manifests") if n.endswith(".json")]
        live = {v for v in versions if v > newest - keep_versions or v in pinned or (older_than_s > 0 and self.files.age(self._name(v)) < older_than_s)}
        named = set()
        for v in live:
            m = self.manifest(v)
            named |= {s["path"] for t in m.tables.values() for s in t["segments"]} | {s["path"] for s in m.kv}
        gone = 0
        for v in versions:
            if v not in live:
                self.files.delete(self._name(v))
                self.held.pop(v, None)
        now = time.time()
        for status in self.files.fs.listStatus(self.files.path("data")) if self.files.exists("data") else []:
            if f"data/{status.getPath().getName()}" not in named and now - status.getModificationTime() / 1000 >= older_than_s:
                self.files.fs.delete(status.getPath(), True)
                gone += 1
        return gone

    def stats(self) -> dict:
        m = self.manifest()
        segments = [s for t in m.tables.values() for s in t["segments"]] + m.kv
        size = sum(self.files.fs.getContentSummary(self.files.path(s["path"])).getLength() for s in segments)
        return {"version": m.version, "tables": len(m.tables), "segments": len(segments), "kv_segments": len(m.kv), "bytes": size, "pins": len(self.files.list("pins"))}
