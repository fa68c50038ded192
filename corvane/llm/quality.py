"""Quality by ordinal cumulative-link regression on graded ratings.

A text is a bag of hashed features: its words, the shapes of its words (runs of upper case, lower case, digits, marks
and other scripts), words that repeat the word before, and its length class. All grades share one weight per feature;
ordered thresholds turn the weighted sum into probabilities of the grades, P(grade <= k) = logistic(threshold_k - sum).
From these follow the expected grade and the tail probability P(grade >= least) that selection uses.

The model is fitted on a bounded sample of labelled rows (MAX_TRAIN, in the order of a hash of doc_id, so it does not
depend on partitions); each sampled row counts with whole text. Every document is scored on its whole text.

Null text counts as empty: no words, only the length class. Labels with null grade or id are ignored; a document with
several labels counts once for each. Without labels, or with a single grade, every document has that grade (0 without
labels) and is kept. Rows with null doc_id are scored too; rows that repeat are scored each; an empty table gives an empty
result. select() keeps all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, textkernel, tokens

#: Labelled rows that the fit may see, and distinct features of each: 8 bytes apiece, 520 MB in all at most, on the driver.
#: A longer text stands in the fit (never in a score) by a hashed choice of them.
MAX_TRAIN, MAX_FEATURES = 8000, 8192
BITS = 15
LEAST_GRADE = 1
KEEP_AT = 0.5
# Byte classes for shapes: 0 mark, 1 upper, 2 lower, 3 digit, 4 beyond ASCII.
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers in text order, their weights, and how many each text has."""
    starts, ends, n = textkernel.words(buf, off)
    mask = np.uint64((1 << BITS) - 1)
    docs = len(n)
    length = ((np.uint64(0xA11CE) + np.ceil(np.log2(n + 1)).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
    if not len(starts):
        return length.astype(np.int64), np.ones(docs), np.ones(docs, np.int64)
    word = textkernel.span_hash(textkernel.prefix(buf), starts, ends)
    # The hash of a word's shape: its byte classes with equal neighbours merged.
    kind = _CLASS[buf]
    turn = np.ones(len(buf), bool)
    turn[1:] = kind[1:] != kind[:-1]
    turn[starts] = True
    places = np.flatnonzero(turn)
    sums = textkernel.prefix(kind[places])
    shape = textkernel.mix(textkernel.span_hash(sums, np.searchsorted(places, starts), np.searchsorted(places, ends)) + np.uint64(1))
    again = np.zeros(len(word), bool)
    again[1:] = word[1:] == word[:-1]
    first = (np.cumsum(n) - n)[n > 0]
    again[first] = False
    repeat = np.where(again, np.uint64(0x5EED1), np.uint64(0x5EED2)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)
    share = np.repeat(1.0 / np.maximum(n, 1), n)
    ids = np.stack([word & mask, shape & mask, repeat], axis=1).ravel().astype(np.int64)
    # One length feature stands before the words of each text.
    counts = 3 * n + 1
    out, weight = np.zeros(int(counts.sum()), np.int64), np.ones(int(counts.sum()))
    begin = np.cumsum(counts) - counts
    rest = np.ones(len(out), bool)
    rest[begin] = False
    out[begin], out[rest], weight[rest] = length.astype(np.int64), ids, np.repeat(share, 3)
    return out, weight, counts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], steps: int = 250, rate: float = 0.15, decay: float = 2e-4) -> dict:
    """Weights and thresholds by maximum likelihood (Adam over all rows); rows: feature numbers, values, grade."""
    grades = sorted({g for _, _, g in rows}) or [0]
    model = {"grades": np.array(grades), "w": np.zeros(1 << BITS), "cuts": np.zeros(0)}
    if len(grades) < 2:
        return model
    ids, values = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    n = np.array([len(r[0]) for r in rows])
    begin, owner = np.cumsum(n) - n, np.repeat(np.arange(len(rows)), n)
    y = np.searchsorted(grades, [r[2] for r in rows])
    share = np.bincount(y, minlength=len(grades)).cumsum()[:-1] / len(y)
    start = np.log(share / (1 - share))
    # Thresholds are ordered: the first, then logarithms of the gaps.
    p = np.concatenate([np.zeros(1 << BITS), start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    k = 1 << BITS
    for t in range(1, steps + 1):
        gaps = np.exp(p[k + 1 :])
        cuts = p[k] + np.concatenate([[0], np.cumsum(gaps)])
        s = np.add.reduceat(p[ids] * values, begin)
        high = np.where(y < len(cuts), _sigmoid(cuts[np.minimum(y, len(cuts) - 1)] - s), 1.0)
        low = np.where(y > 0, _sigmoid(cuts[np.maximum(y - 1, 0)] - s), 0.0)
        inside = np.maximum(high - low, 1e-9)
        ds = high + low - 1
        dcut = np.bincount(np.minimum(y, len(cuts) - 1), np.where(y < len(cuts), high * (1 - high) / inside, 0), len(cuts)) - np.bincount(np.maximum(y - 1, 0), np.where(y > 0, low * (1 - low) / inside, 0), len(cuts))
        tail = np.cumsum(dcut[::-1])[::-1]
        g = np.concatenate([np.bincount(ids, values * ds[owner], k), tail[:1], tail[1:] * gaps]) / len(rows)
        g[:k] -= decay * p[:k]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return model | {"w": p[:k], "cuts": p[k] + np.concatenate([[0], np.cumsum(np.exp(p[k + 1 :]))])}


def train(docs: DataFrame, labels: DataFrame, grade: str = "quality", max_train: int = MAX_TRAIN, max_features: int = MAX_FEATURES) -> dict:
    """Weights, thresholds and grades."""
    rated = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(grade).cast("int").alias("grade")).where("doc_id is not null and grade is not null")
    # At most max_train ids: a bounded side, so it may be broadcast.
    some = rated.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(max_train)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        for batch in batches:
            buf, off = textkernel.raw(batch.column(2))
            for a, b in textkernel.steps(off):
                ids, weight, counts = features(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                out: tuple[list, list] = ([], [])
                for x, w in zip(np.split(ids, np.cumsum(counts)[:-1]), np.split(weight, np.cumsum(counts)[:-1])):
                    u, inverse = np.unique(x, return_inverse=True)
                    u, w = textkernel.sketched(u, np.bincount(inverse, w, len(u)), max_features)
                    out[0].append(u.astype(np.int32))
                    out[1].append(w.astype(np.float32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(out[0], pa.list_(pa.int32())), pa.array(out[1], pa.list_(pa.float32()))], names=["doc_id", "grade", "ids", "weights"]
                )

    got = texts.select("doc_id", "grade", "text").mapInArrow(run, "doc_id long, grade int, ids array<int>, weights array<float>").toArrow()
    rows = sorted(zip(got["doc_id"].to_pylist(), got["grade"].to_pylist(), range(got.num_rows)))
    ids, weights = (got[c].combine_chunks() if got.num_rows else [] for c in ("ids", "weights"))
    return fit([(ids[i].values.to_numpy().astype(np.int64), weights[i].values.to_numpy().astype(float), g) for _, g, i in rows])


def score(docs: DataFrame, model: dict, least: int = LEAST_GRADE, keep_at: float = KEEP_AT, columns: list[str] | None = None) -> DataFrame:
    """columns (doc_id if none are named), expected_grade, p_tail (of a grade of at least `least`), keep."""
    columns = columns or ["doc_id"]
    spark = docs.sparkSession
    scratch.ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        m = shared.value
        for batch in batches:
            buf, off = textkernel.raw(batch.column(batch.num_columns - 1))
            for a, b in textkernel.steps(off):
                ids, weight, counts = features(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                s = np.add.reduceat(m["w"][ids] * weight, np.cumsum(counts) - counts)
                below = np.concatenate([np.zeros((len(s), 1)), _sigmoid(m["cuts"][None, :] - s[:, None]), np.ones((len(s), 1))], axis=1)
                p = np.diff(below, axis=1)
                expected = p @ m["grades"]
                tail = p[:, m["grades"] >= least].sum(axis=1)
                kept = (tail >= keep_at) | (len(m["cuts"]) == 0)
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:-1]), pa.array(expected), pa.array(tail), pa.array(kept)], names=[*columns, "expected_grade", "p_tail", "keep"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[f"`{c}`" for c in columns]).schema)
    text = F.col("text").cast("string").alias("_text")
    return docs.select(*[F.col(f"`{c}`") for c in columns], text).mapInArrow(run, f"{fields}, expected_grade double, p_tail double, keep boolean")


def select(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that the classifier keeps; all columns as they were (none may be named like its outputs)."""
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.col("text"))
    scored = score(renamed, train(docs, labels), columns=list(names.values()), **options).where("keep")
    return scored.select(*[F.col(n).alias(c) for c, n in names.items()])
