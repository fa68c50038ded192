"""Files that arrive in a folder, streamed into the key-value log: one batch of the log for each micro-batch.

The id of the last micro-batch stands in the log's own manifest, so a micro-batch that is replayed after a failure is
not written twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sources.kv import KeyValue


def key_value_stream(stream: DataFrame, kv: KeyValue, key: str, value: str, checkpoint: str, name: str = "ingest") -> StreamingQuery:
    """Starts a query that appends key and value (SQL expressions) of each new row; of equal keys the greatest value stays."""

    def write(batch: DataFrame, number: int) -> None:
        done = kv.store.manifest().meta.get("streams", {}).get(name, -1)
        if number <= done:
            return
        rows = batch.select(F.expr(key).cast("string").alias("key"), F.expr(value).cast("string").alias("value")).where("key is not null and value is not null")
        rows = rows.groupBy("key").agg(F.max("value").alias("value"))
        zero = F.lit(0).cast("long")
        segment = kv.store.write(rows.select(F.lit(kv.namespace).alias("namespace"), "key", "value", zero.alias("seq"), zero.alias("expiry"), F.lit(False).alias("deleted")), "kv")

        def change(m) -> None:
            m.kv.append(segment | {"seq": m.version})
            m.meta.setdefault("streams", {})[name] = number

        kv.store.commit(kv.store.latest(), change, {"kv": {kv.namespace: None}})

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def parquet_stream(spark, folder: str, schema: StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)
