"""Set operators. ALL forms of INTERSECT and EXCEPT are filters of the left rows, not bag operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def combine(op: str, every: bool, left: DataFrame, right: DataFrame) -> DataFrame:
    names = [f"s{i}" for i in range(len(left.columns))]
    if len(left.columns) != len(right.columns):
        from ..errors import SqlSyntaxError

        raise SqlSyntaxError(f"each side of {op.upper()} must have the same number of columns")
    shown = left.columns
    a, b = left.toDF(*names), right.toDF(*names)
    if op == "union":
        out = a.union(b) if every else a.union(b).distinct()
    elif not every:
        out = a.intersect(b) if op == "intersect" else a.subtract(b)
    else:
        b = b.distinct().toDF(*[f"r{i}" for i in range(len(names))])
        same = reduce(lambda x, y: x & y, (a[f"s{i}"].eqNullSafe(b[f"r{i}"]) for i in range(len(names))))
        out = a.join(b, same, "left_semi" if op == "intersect" else "left_anti")
    return out.toDF(*shown)
