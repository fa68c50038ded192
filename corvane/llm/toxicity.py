"""Toxicity by averaged subword embeddings and a linear softmax, trained together in numpy.

A word is lower-cased and its outer marks are cut off; it is the bag of itself, its first and last three bytes and all its
byte n-grams of three to five, each hashed to a row of an embedding table. A text is the mean over its words of the mean
of a word's rows. A two-class linear softmax sits on that mean. Embeddings and softmax are trained jointly by
minibatches (Adagrad), so a misspelling that was never seen shares most of its rows with the word it is made from.

The model is fitted on a bounded sample of labelled rows: at most MAX_TRAIN of the two classes, in the order of a hash
of doc_id; the classes' true shares, counted over all labels, correct the bias. Rows whose crc32(doc_id) mod 5 is 0 are
never seen in training. Only the text enters a score.

Null text counts as empty and, like any text without words, gets the score of the bias. Labels that are null are
ignored. Without labels of both classes every score is the share of class 1 (0 without labels). Rows that repeat are scored
each; a null doc_id stays null, as does its held_out, and is scored; an empty table gives an empty result. Further columns
are ignored, also if they are named like outputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch, textkernel, tokens

#: Labelled rows of class 0 and of class 1 that the fit may see, and distinct table rows of each: 8 bytes apiece, 460 MB
#: in all at most, on the driver. A longer text stands in the fit (never in a score) by a hashed choice of them.
MAX_TRAIN, MAX_FEATURES = (4500, 2500), 8192
BITS, WIDTH, SCALE = 18, 6, 40.0
GRAMS = (3, 4, 5)
_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) == 0


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the table in text order, their weights (one in all for each text with words), and their number by text."""
    starts, ends, _ = textkernel.words(buf, off)
    letters = np.flatnonzero(_LETTER[buf])
    a, b = np.searchsorted(letters, starts), np.searchsorted(letters, ends)
    some = b > a
    starts, ends = letters[a[some]], letters[b[some] - 1] + 1
    n = np.diff(np.searchsorted(starts, off))
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(len(n), np.int64)
    sums, size = textkernel.prefix(buf), ends - starts
    each = [np.maximum(size - g + 1, 0) for g in GRAMS]
    total = 3 + sum(each)
    out = np.zeros(int(total.sum()), np.uint64)
    begin = np.cumsum(total) - total
    near = np.minimum(size, 3)
    for k, (x, y) in enumerate(((starts, ends), (starts, starts + near), (ends - near, ends))):
        out[begin + k] = textkernel.span_hash(sums, x, y) * np.uint64(2 * k + 3)
    at = begin + 3
    for g, m in zip(GRAMS, each):
        step = textkernel.spread(m)
        place = np.repeat(starts, m) + step
        out[np.repeat(at, m) + step] = textkernel.span_hash(sums, place, place + g)
        at = at + m
    per_text = np.add.reduceat(np.append(total, 0), np.append(np.cumsum(n) - n, len(total))[:-1]) * (n > 0)
    weight = np.repeat(1.0 / (total * np.repeat(n, n)), total)
    return (out >> np.uint64(64 - BITS)).astype(np.int64), weight, per_text


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], share: float, epochs: int = 10, rate: float = 0.12, size: int = 50) -> tuple[np.ndarray, float]:
    """What each row of the table adds to the log odds of class 1, and the bias; rows: table rows, weights, class."""
    y = np.array([r[2] for r in rows], np.int64)
    if not len(y) or y.min() == y.max():
        return np.zeros(1 << BITS), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    rng = np.random.default_rng(5)
    table = rng.normal(0, 0.1, (1 << BITS, WIDTH))
    soft, bias = rng.normal(0, 0.1, (WIDTH, 2)), np.zeros(2)
    seen_t, seen_s, seen_b = np.full(1 << BITS, 1e-6), np.full((WIDTH, 2), 1e-6), np.full(2, 1e-6)
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), size):
            some = order[at : at + size]
            n = np.array([len(rows[i][0]) for i in some])
            ids, w = np.concatenate([rows[i][0] for i in some]).astype(np.int64), np.concatenate([rows[i][1] for i in some]) * SCALE
            owner = np.repeat(np.arange(len(some)), n)
            used, which = np.unique(ids, return_inverse=True)
            mine = table[used]
            mean = np.stack([np.bincount(owner, w * mine[which, d], len(some)) for d in range(WIDTH)], axis=1)
            logits = np.einsum("ij,jk->ik", mean, soft) + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), y[some]] -= 1
            p /= len(some)
            back = np.einsum("ij,kj->ik", p, soft)
            g = np.stack([np.bincount(which, w * back[owner, d], len(used)) for d in range(WIDTH)], axis=1)
            gs, gb = np.einsum("ij,ik->jk", mean, p), p.sum(axis=0)
            seen_t[used] += (g * g).mean(axis=1)
            seen_s += gs * gs
            seen_b += gb * gb
            table[used] -= rate * g / np.sqrt(seen_t[used])[:, None]
            soft -= rate * gs / np.sqrt(seen_s)
            bias -= rate * gb / np.sqrt(seen_b)
    true, had = np.log(share / (1 - share)), np.log(y.mean() / (1 - y.mean()))
    return SCALE * np.einsum("ij,j->i", table, soft[:, 1] - soft[:, 0]), float(bias[1] - bias[0] + true - had)


def _lowered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return textkernel.raw(pa.array([(t or "").lower() for t in textkernel.strings(texts)], pa.string()))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_train: tuple[int, int] = MAX_TRAIN, max_features: int = MAX_FEATURES) -> tuple[np.ndarray, float]:
    """What each row of the table adds to the log odds, and the bias."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(~held_out())
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    # At most max_train ids of a class: a bounded side, so it may be broadcast.
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train[y]) for y in (0, 1)]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                ids, weight, counts = features(*_lowered(part.column(2)))
                got: tuple[list, list] = ([], [])
                for x, w in zip(np.split(ids, np.cumsum(counts)[:-1]), np.split(weight, np.cumsum(counts)[:-1])):
                    u, inverse = np.unique(x, return_inverse=True)
                    u, w = textkernel.sketched(u, np.bincount(inverse, w, len(u)), max_features)
                    got[0].append(u.astype(np.uint32).tobytes())
                    got[1].append(w.astype(np.float32).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(got[0], pa.binary()), pa.array(got[1], pa.binary())], names=["doc_id", "y", "ids", "weights"])

    rows = texts.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, ids binary, weights binary").toArrow()
    order = sorted(zip(rows["doc_id"].to_pylist(), rows["y"].to_pylist(), range(rows.num_rows)))
    ids, weights = rows["ids"], rows["weights"]
    return fit([(np.frombuffer(ids[i].as_buffer(), np.uint32), np.frombuffer(weights[i].as_buffer(), np.float32), y) for _, y, i in order], share)


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    spark = docs.sparkSession
    scratch.ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        table, bias = shared.value
        for batch in batches:
            buf, off = _lowered(batch.column(2))
            out = [np.zeros(0)]
            for a, b in textkernel.steps(off, 1 << 19):
                ids, weight, counts = features(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                sums = np.concatenate([[0.0], np.cumsum(table[ids] * weight)])
                ends = np.cumsum(counts)
                odds = sums[ends] - sums[ends - counts] + bias
                out.append(1 / (1 + np.exp(-np.clip(odds, -40, 40))))
            p = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return columns.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
