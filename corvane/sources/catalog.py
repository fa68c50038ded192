"""Tables by name: managed ones in a store's manifest, external Parquet folders read-only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import UndefinedTable
from ..functions.types import of_spark
from ..plans.lowering import Table


class External:
    """Read-only tables, resolved once when they are registered: their schema is never inferred again."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, {}

    def register(self, name: str, df: DataFrame, primary_key: str | None = None) -> None:
        columns = [(f.name, of_spark(f.dataType)) for f in df.schema]
        # Zoned timestamps and dates become timestamps without zone, the dialect's only kind.
        odd = {f.name: F.col(f"`{f.name}`").cast("timestamp_ntz") for f in df.schema if f.dataType.typeName() in ("timestamp", "date")}
        self.tables[name.lower()] = Table(name, columns, primary_key or df.columns[0], df.withColumns(odd) if odd else df)

    def register_parquet(self, name: str, path: str, primary_key: str | None = None) -> None:
        self.register(name, self.spark.read.parquet(path), primary_key)

    def drop(self, name: str) -> bool:
        return self.tables.pop(name.lower(), None) is not None


def missing(name: str) -> UndefinedTable:
    return UndefinedTable(f"Table '{name}' does not exist")
