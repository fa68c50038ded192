"""Plans as text, before a run and with a run's own numbers."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame


def planned(df: DataFrame, mode: str = "formatted") -> list[str]:
    jvm = df.sparkSession.sparkContext._jvm
    return jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode).splitlines()


def analyzed(df: DataFrame) -> list[str]:
    """Runs the plan once, without fetching rows, and reads the metrics of every node of the plan that really ran."""
    execution = df._jdf.queryExecution()
    began = time.perf_counter()
    rows = execution.toRdd().count()
    took = (time.perf_counter() - began) * 1000
    out = [f"Total rows={rows} time={took:.1f} ms"]

    def walk(node, depth: int) -> None:
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan(), depth)
        shown, metrics = [], node.metrics()
        keys = metrics.keys().iterator()
        while keys.hasNext():
            k = keys.next()
            m = metrics.apply(k)
            v = m.value()
            if v > 0 and (k == "numOutputRows" or "ime" in k or "ize" in k):
                shown.append(f"{k}={v}")
        inner = node.plan() if "QueryStage" in name else None
        if inner is None:
            out.append("  " * depth + f"-> {name}" + (f" ({', '.join(sorted(shown))})" if shown else ""))
        for child in ([inner] if inner is not None else _children(node)):
            walk(child, depth + (inner is None))

    walk(execution.executedPlan(), 0)
    return out


def _children(node) -> list:
    children = node.children()
    return [children.apply(i) for i in range(children.size())]
