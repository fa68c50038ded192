"""Versioned changes of JSON documents, recorded in the store's manifest.

Each migration has a number, up steps and down steps; a step is one of AddField (only where absent), RemoveField,
RenameField, CreateIndex, DropIndex. A migration that is already applied is skipped. Documents are rewritten by one
distributed pass; member order and nested values stay as they are.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import functions as F

from .errors import CorvaneError, SerializationFailure
from .indexes import IndexManager
from .sources.kv import KeyValue, meets


@dataclass(frozen=True)
class AddField:
    collection: str
    name: str
    default: Any


@dataclass(frozen=True)
class RemoveField:
    collection: str
    name: str


@dataclass(frozen=True)
class RenameField:
    collection: str
    old: str
    new: str


@dataclass(frozen=True)
class CreateIndex:
    name: str
    collection: str
    fields: tuple[str, ...]
    unique: bool = False


@dataclass(frozen=True)
class DropIndex:
    name: str


@dataclass(frozen=True)
class Migration:
    version: int
    name: str
    up: tuple = ()
    down: tuple = ()


def _rewrite(step):
    def one(text: str) -> str | None:
        try:
            doc = json.loads(text)
        except ValueError:
            return None
        if not isinstance(doc, dict):
            return None
        if isinstance(step, AddField):
            if step.name in doc:
                return None
            doc[step.name] = step.default
        elif isinstance(step, RemoveField):
            if step.name not in doc:
                return None
            del doc[step.name]
        else:
            if step.old not in doc:
                return None
            doc = {step.new if k == step.old else k: v for k, v in doc.items() if k == step.old or k != step.new}
        return json.dumps(doc)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in parts:
            yield values.map(one)

    return F.pandas_udf(run, "string")


@dataclass
class Migrator:
    kv: KeyValue
    migrations: list[Migration] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.migrations = sorted(self.migrations, key=lambda m: m.version)
        if len({m.version for m in self.migrations}) < len(self.migrations):
            raise CorvaneError("two migrations have one version")

    def _log(self) -> list[dict]:
        return self.kv.store.manifest().meta.get("migrations", [])

    def migration_log(self) -> list[dict]:
        return list(self._log())

    def _note(self, m: Migration, state: str) -> None:
        entry = {"version": m.version, "name": m.name, "state": state, "at": time.time()}
        self.kv.store.commit(self.kv.store.latest(), lambda x: x.meta.setdefault("migrations", []).append(entry), {})

    def _states(self) -> dict[int, str]:
        return {e["version"]: e["state"] for e in self._log()}

    def migration_status(self) -> list[tuple[int, str, str]]:
        states = self._states()
        return [(m.version, m.name, states.get(m.version, "Pending")) for m in self.migrations]

    def current_version(self) -> int:
        return max((v for v, s in self._states().items() if s == "Applied"), default=0)

    def migrate_up(self) -> int:
        return self.migrate_to(self.migrations[-1].version) if self.migrations else 0

    def migrate_down(self) -> int:
        """One version back."""
        applied = [m for m in self.migrations if self._states().get(m.version) == "Applied"]
        if applied:
            self._apply(applied[-1], applied[-1].down, "RolledBack")
        return self.current_version()

    def migrate_to(self, version: int) -> int:
        for m in self.migrations:
            if m.version <= version and self._states().get(m.version) != "Applied":
                self._apply(m, m.up, "Applied")
        for m in reversed(self.migrations):
            if m.version > version and self._states().get(m.version) == "Applied":
                self._apply(m, m.down, "RolledBack")
        return self.current_version()

    def _apply(self, m: Migration, steps: tuple, state: str) -> None:
        self._note(m, "InProgress")
        try:
            for s in steps:
                self._step(s)
        except Exception:
            self._note(m, "Failed")
            raise
        self._note(m, state)

    def _step(self, s) -> None:
        indexes = IndexManager(self.kv)
        if isinstance(s, CreateIndex):
            if s.name not in indexes.list():
                indexes.create_index(s.name, s.collection, list(s.fields), s.unique)
        elif isinstance(s, DropIndex):
            if s.name in indexes.list():
                indexes.drop_index(s.name)
        else:
            self._documents(s)

    def _documents(self, s) -> None:
        """Rewrites a collection as it is at one version; if a document is written meanwhile, all is done again."""
        head = f"{s.collection}:"
        while True:
            base = self.kv.store.latest()
            rows = self.kv.frame(version=base, prefix=head).withColumn("new", _rewrite(s)("value")).where("new is not null")
            changed = rows.select(F.lit(self.kv.namespace).alias("namespace"), "key", F.col("new").alias("value"), F.lit(0).cast("long").alias("seq"), "expiry", F.lit(False).alias("deleted"))
            try:
                self.kv.append(changed, None, base, meets(self.kv.namespace, head, head + "\U0010ffff"))
                return
            except SerializationFailure:
                continue
