"""Ranking over a whole table without bringing its rows to one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import order
from ..sources import workspace

#: Bits of a row's number within its range in monotonically_increasing_id().
_LOCAL = 33


def global_rank(df: DataFrame, function: str, key: str, descending: bool, ties: list[Column], out: str) -> DataFrame:
    """df with a ranking by one column and no partition.

    Rows are counted for each distinct value (for ROW_NUMBER: value and ties) before they move. The counts are sorted over
    ranges of values and written, when the plan is made, to the session's workspace: ranges would differ if they were cut
    again. One total a range comes to the driver; each range numbers its own values. The sums are joined back by value
    (NULL is a value).
    """
    spark = df.sparkSession
    by = [F.col(key), *(ties if function == "row_number" else [])]
    names = [f"_k{i}" for i in range(len(by))]
    directions = [order(F.col(n), descending and i == 0) for i, n in enumerate(names)]
    counts = df.groupBy(*[c.alias(n) for c, n in zip(by, names)]).agg(F.count(F.lit(1)).alias("_n"))
    ranged = counts.repartitionByRange(*directions).sortWithinPartitions(*directions).withColumn("_m", F.monotonically_increasing_id())
    at = workspace.folder(spark)
    ranged.write.parquet(at)
    ranged = spark.read.schema(ranged.schema).parquet(at).withColumn("_range", F.shiftright("_m", _LOCAL))
    total = F.count(F.lit(1)) if function == "dense_rank" else F.sum("_n")
    begin, before = [], 0
    for r in sorted(ranged.groupBy("_range").agg(total.alias("total")).collect()):
        begin.append((r["_range"], before))
        before += r["total"]
    begun = F.broadcast(spark.createDataFrame(begin, "_range long, _begin long"))
    along = Window.partitionBy("_range").orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.col("_m").bitwiseAND((1 << _LOCAL) - 1) if function == "dense_rank" else F.coalesce(F.sum("_n").over(along), F.lit(0))
    base = ranged.withColumn("_inside", inside).join(begun, "_range").select(*names, (F.col("_begin") + F.col("_inside") + 1).cast("long").alias("_base"))
    joined = df.join(base, reduce(lambda a, b: a & b, [c.eqNullSafe(F.col(n)) for c, n in zip(by, names)]))
    if function == "row_number":
        # Rows equal in value and ties, of which a table with a primary key has none, are numbered in any order.
        again = F.row_number().over(Window.partitionBy("_base").orderBy(F.lit(0)))
        return joined.withColumn(out, (F.col("_base") + again - 1).cast("long")).drop(*names, "_base")
    return joined.withColumn(out, F.col("_base")).drop(*names, "_base")


def partitioned_rank(df: DataFrame, function: str, by: list[str], key: str, descending: bool, ties: list[Column], out: str) -> DataFrame:
    over = Window.partitionBy(*by).orderBy(order(F.col(key), descending), *([order(t, False) for t in ties] if function == "row_number" else []))
    return df.withColumn(out, {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}[function]().over(over).cast("long"))
