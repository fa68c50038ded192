"""Secondary indexes over JSON documents at <collection>:<key> in the key-value log.

An index is an entry of the store's manifest: fields are read from the documents when it is used, so there is nothing to
backfill or rebuild, and Spark prunes and filters. A document without one of the fields is not in the index.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .errors import CorvaneError, SerializationFailure, UniqueViolation
from .sources.kv import Batch, KeyValue, meets


def field(name: str) -> Column:
    """A top-level member of the document in column value, with its JSON type as a variant."""
    return F.try_variant_get(F.try_parse_json("value"), f"$['{name}']", "variant")


def _typed(name: str, like) -> Column:
    kind = "boolean" if isinstance(like, bool) else "bigint" if isinstance(like, int) else "double" if isinstance(like, float) else "string"
    return F.try_variant_get(F.try_parse_json("value"), f"$['{name}']", kind)


def _kind(like) -> tuple[str, ...]:
    """Variant types that a value of this Python type may equal."""
    return ("BOOLEAN",) if isinstance(like, bool) else ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT") if isinstance(like, (int, float)) else ("STRING",)


class IndexManager:
    def __init__(self, kv: KeyValue):
        self.kv, self.store = kv, kv.store

    def _meta(self) -> dict:
        return self.store.manifest().meta.get("indexes", {})

    def _put(self, name: str, entry: dict | None) -> None:
        def change(m) -> None:
            known = m.meta.setdefault("indexes", {})
            if entry is None:
                known.pop(name, None)
            else:
                known[name] = entry

        self.store.commit(self.store.latest(), change, {})

    def create_index(self, name: str, collection: str, fields: list[str], unique: bool = False) -> None:
        if name in self._meta():
            raise CorvaneError(f"index {name} already exists")
        self._put(name, {"collection": collection, "fields": list(fields), "unique": unique, "namespace": self.kv.namespace})

    def drop_index(self, name: str) -> None:
        self._entry(name)
        self._put(name, None)

    def list(self) -> list[str]:
        return sorted(self._meta())

    def _entry(self, name: str) -> dict:
        entry = self._meta().get(name)
        if not entry:
            raise CorvaneError(f"index {name} does not exist")
        return entry

    def documents(self, collection: str, version: int | None = None) -> DataFrame:
        """pk, key, value of a collection."""
        head = f"{collection}:"
        return self.kv.frame(version=version, prefix=head).select(F.expr(f"substring(key, {len(head) + 1})").alias("pk"), "key", "value")

    def indexed(self, name: str, version: int | None = None) -> DataFrame:
        entry = self._entry(name)
        df = self.documents(entry["collection"], version)
        for f in entry["fields"]:
            df = df.where(field(f).isNotNull())
        return df

    def put_document(self, collection: str, pk: str, doc: dict) -> None:
        """Writes a document after the check of unique indexes; both hold for one version, or both are done again."""
        while True:
            base, unique = self.store.latest(), False
            for name, entry in self._meta().items():
                if entry["collection"] == collection and entry["unique"] and all(f in doc for f in entry["fields"]):
                    unique = True
                    others = [p for p in self.lookup(name, [doc[f] for f in entry["fields"]], base) if p != pk]
                    if others:
                        raise UniqueViolation(f"unique index {name} already has these values, in document {others[0]}")
            head = f"{collection}:"
            try:
                self.kv.write_batch(Batch().put(head + pk, json.dumps(doc)), base, meets(self.kv.namespace, head, head + "\U0010ffff") if unique else None)
                return
            except SerializationFailure:
                continue

    def remove_document(self, collection: str, pk: str) -> None:
        self.kv.delete(f"{collection}:{pk}")

    def matching(self, df: DataFrame, fields: list[str], values: list) -> DataFrame:
        for f, v in zip(fields, values):
            df = df.where(F.schema_of_variant(field(f)).rlike("^(" + "|".join(_kind(v)) + ")") & (_typed(f, v) == F.lit(v)))
        return df

    def lookup(self, name: str, values: list, version: int | None = None) -> list[str]:
        """Keys of documents with exactly these field values."""
        entry = self._entry(name)
        if len(values) != len(entry["fields"]):
            raise CorvaneError(f"index {name} has {len(entry['fields'])} fields")
        return sorted(r["pk"] for r in self.matching(self.indexed(name, version), entry["fields"], values).select("pk").toLocalIterator())

    def range_frame(self, name: str, low, high) -> DataFrame:
        """pk and v, the one field's value, of documents with it from low to high, both included."""
        entry = self._entry(name)
        if len(entry["fields"]) != 1:
            raise CorvaneError("a range scan needs an index of one field")
        f = entry["fields"][0]
        right_kind = F.schema_of_variant(field(f)).rlike("^(" + "|".join(_kind(low)) + ")")
        return self.indexed(name).select("pk", _typed(f, low).alias("v"), right_kind.alias("ok")).where(F.col("ok") & F.col("v").between(low, high)).drop("ok")

    def range_scan(self, name: str, low, high) -> list[str]:
        """Keys in the order of the field."""
        return [r["pk"] for r in self.range_frame(name, low, high).orderBy("v", "pk").toLocalIterator()]

    def violations(self, name: str) -> DataFrame:
        """Field values that more than one document has."""
        entry = self._entry(name)
        keys = [_typed(f, "").alias(f"f{i}") for i, f in enumerate(entry["fields"])]
        return self.indexed(name).groupBy(*keys).count().where("count > 1")

    def rebuild_index(self, name: str) -> int:
        """Nothing is materialised; returns how many documents the index has."""
        return self.indexed(name).count()
