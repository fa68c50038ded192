"""Import of JSON lines into the key-value log, and verification by an order-free checksum."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sources.kv import KeyValue


def read_jsonl(spark, path: str, key_field: str | None = None, prefix: str = "") -> DataFrame:
    """key, value: the raw line under a member's text, or under its padded line number (byte order across files)."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    if key_field:
        key = F.try_variant_get(F.try_parse_json("value"), f"$['{key_field}']", "string")
        return lines.select(F.concat(F.lit(prefix), key).alias("key"), "value").where("key is not null")
    numbered = lines.rdd.map(lambda r: r[0]).zipWithIndex().toDF("value string, n long")
    return numbered.select(F.concat(F.lit(prefix), F.lpad(F.col("n").cast("string"), 20, "0")).alias("key"), "value")


def checksum() -> Column:
    """The sum over rows of crc32(key, zero byte, value), modulo 2 to the 64."""
    one = F.crc32(F.concat(F.col("key").cast("binary"), F.lit(bytearray(b"\0")), F.col("value").cast("binary")))
    return (F.sum(one.cast("decimal(20,0)")) % F.lit(str(1 << 64)).cast("decimal(20,0)")).cast("decimal(20,0)")


@dataclass
class Report:
    rows: int
    mismatches: int
    checksum: int


def load(kv: KeyValue, rows: DataFrame) -> int:
    """Appends key, value rows as one batch; of equal keys in it the greatest value stays."""
    seen = rows.groupBy("key").agg(F.max("value").alias("value"))
    return kv.append(seen.select(F.lit(kv.namespace).alias("namespace"), "key", "value", F.lit(0).cast("long").alias("seq"), F.lit(0).cast("long").alias("expiry"), F.lit(False).alias("deleted")))


def verify(kv: KeyValue, rows: DataFrame) -> Report:
    """Compares rows (key, value) with what the store gives back."""
    seen = rows.groupBy("key").agg(F.max("value").alias("value"))
    there = kv.frame().select(F.col("key").alias("k"), F.col("value").alias("v"))
    both = seen.join(there, F.col("key") == F.col("k"), "left")
    got = both.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("value").eqNullSafe(F.col("v"))).alias("bad"), checksum().alias("c")).first()
    return Report(got["n"], got["bad"], int(got["c"] or 0))
