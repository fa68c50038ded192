"""Copies of one version of a store, with a checksum for each file."""

from __future__ import annotations

import json
import zlib

from pyspark.sql import SparkSession

from ..errors import CorvaneError
from .files import Files
from .store import Store


def _bytes(files: Files, name: str) -> bytes:
    stream = files.fs.open(files.path(name))
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def _checks(spark: SparkSession, root: str, folders: list[str]) -> dict[str, int]:
    """crc32 of every data file, computed where the files are read."""
    from pyspark.sql import functions as F

    if not folders:
        return {}
    # A file is one row: segments are written in files of Spark's usual size.
    got = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([f"{root}/{f}" for f in folders])
    rows = got.where("path not like '%/_SUCCESS'").select("path", F.crc32("content").alias("crc")).collect()
    return {"/".join(r["path"].split("/")[-3:]): r["crc"] for r in rows}


def create(store: Store, to: str) -> int:
    """Copies the newest manifest and what it names; returns its version."""
    spark, m = store.spark, store.manifest()
    there = Files(spark, to)
    folders = sorted({s["path"] for t in m.tables.values() for s in t["segments"]} | {s["path"] for s in m.kv})
    copy = spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy
    for f in folders:
        there.fs.mkdirs(there.path(f).getParent())
        copy(store.files.fs, store.files.path(f), there.fs, there.path(f), False, there.conf)
    text = m.dumps()
    there.put("backup.json", json.dumps({"version": m.version, "manifest_crc": zlib.crc32(text.encode()), "files": _checks(spark, store.root, folders)}))
    there.put("manifest.json", text)
    return m.version


def verify(spark: SparkSession, at: str) -> None:
    files = Files(spark, at)
    info, text = json.loads(files.read("backup.json")), _bytes(files, "manifest.json")
    if zlib.crc32(text) != info["manifest_crc"]:
        raise CorvaneError("backup manifest is damaged")
    m = json.loads(text)
    folders = sorted({s["path"] for t in m["tables"].values() for s in t["segments"]} | {s["path"] for s in m["kv"]})
    for f in folders:
        if ".." in f or not f.startswith("data/"):
            raise CorvaneError(f"backup names a file outside its folder: {f}")
    if _checks(spark, files.root, folders) != info["files"]:
        raise CorvaneError("backup data are damaged")


def restore(spark: SparkSession, at: str, to: str) -> Store:
    """A new store in an empty folder, after verification."""
    verify(spark, at)
    there, here = Files(spark, to), Files(spark, at)
    if there.list():
        raise CorvaneError(f"{to} is not empty")
    copy = spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy
    if here.exists("data"):
        copy(here.fs, here.path("data"), there.fs, there.path("data"), False, there.conf)
    text = here.read("manifest.json")
    there.fs.mkdirs(there.path("manifests"))
    there.put_new(Store._name(json.loads(text)["version"]), text)
    return Store(spark, to)
