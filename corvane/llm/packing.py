"""Packing documents into fixed-length training sequences as a cutting-stock problem.

A document's ids are cut into whole sequences from its start and one rest. Rests are the items: a histogram over
length classes (multiples of a quantum, rounded up) goes to the driver, at most capacity / quantum counts whatever the
input. There a linear program over cutting patterns is solved by column generation: the simplex basis gives a price to
each class and an unbounded-knapsack dynamic program finds the pattern worth most at these prices, until the
bound that follows from the best pattern's worth is less than half a sequence away. Patterns are rounded down to whole uses, and what is left over is placed
best fit. The executors then deal ranked documents to the patterns: the rank of a rest within its class says which use
of which pattern it fills, so the plan is looked up and no group of documents is ever gathered in one place.

Null or empty text counts as the end id alone. Repeated rows are packed once each. Any further columns are ignored.
An empty table gives an empty result with the same columns.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch, tokens

CAPACITY = 2048
QUANTUM = 8
#: Pieces of text whose ids a worker keeps.
KEPT = 500_000


def knapsack(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best worth of items of sizes 1..len(values), any number of each, in a bin of this capacity; how many of each."""
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    sizes = np.arange(1, len(values) + 1)
    for c in range(1, capacity + 1):
        m = min(c, len(values))
        worth = values[:m] + best[c - sizes[:m]]
        k = int(worth.argmax())
        if worth[k] > best[c - 1] + 1e-12:
            best[c], take[c] = worth[k], k + 1
        else:
            best[c] = best[c - 1]
    pattern, c = np.zeros(len(values), np.int64), capacity
    while c > 0:
        if take[c]:
            pattern[take[c] - 1] += 1
            c -= int(take[c])
        else:
            c -= 1
    return float(best[capacity]), pattern


def column_generation(demand: np.ndarray, capacity: int, rounds: int = 4000) -> tuple[list[np.ndarray], np.ndarray]:
    """Patterns and their uses in an optimum of the linear program: least sequences that meet the demand of each class.

    A revised simplex with one row for each class that has demand; demand[i] counts items of size i + 1.
    """
    rows = np.flatnonzero(demand)
    if not len(rows):
        return [], np.zeros(0)
    # Small distinct amounts on top keep the simplex from circling where rows tie.
    need = demand[rows] + np.random.default_rng(len(rows)).uniform(1e-3, 5e-2, len(rows))
    each = capacity // (rows + 1)
    patterns = [np.where(np.arange(len(demand)) == r, e, 0) for r, e in zip(rows, each)]
    inverse, x = np.diag(1.0 / each), need / each
    bound, center = 0.0, 1.0 / each

    def price(prices: np.ndarray) -> tuple[float, np.ndarray]:
        nonlocal bound, center
        values = np.zeros(len(demand))
        values[rows] = np.maximum(prices, 0)
        worth, pattern = knapsack(values, capacity)
        # Prices divided by the best worth are feasible in the dual, so their value bounds the optimum from below.
        if (least := need @ values[rows] / max(worth, 1)) > bound:
            bound, center = least, values[rows] / max(worth, 1)
        return worth, pattern

    for k in range(rounds):
        prices = inverse.sum(axis=0)
        # Prices half way to the best so far swing less; where their pattern does not help, the true prices decide.
        _, new = price((prices + center) / 2)
        if prices @ new[rows] <= 1 + 1e-6:
            worth, new = price(prices)
            if worth <= 1 + 1e-6:
                break
        if x.sum() - bound < 0.5:
            break
        way = inverse @ new[rows]
        ratio = np.where(way > 1e-7, x / np.where(way > 1e-7, way, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        step = ratio[out]
        x = x - step * way
        x[out] = step
        row = inverse[out] / way[out]
        inverse = inverse - np.outer(way, row)
        inverse[out] = row
        patterns[out] = new
        if k % 50 == 49:
            # One Newton step takes out rounding errors (einsum: no BLAS threads beside the JVM).
            basis = np.array([p[rows] for p in patterns], float).T
            inverse = inverse + np.einsum("ij,jk->ik", inverse, np.eye(len(rows)) - np.einsum("ij,jk->ik", basis, inverse))
            x = np.maximum(inverse @ need, 0)
    return patterns, np.maximum(x, 0)


def best_fit(left: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Patterns, one a sequence, that hold the remaining items: largest first, each where least room stays."""
    room = np.zeros(capacity + 1, np.int64)
    held: dict[int, list[dict[int, int]]] = {}
    for size in range(len(left), 0, -1):
        for _ in range(int(left[size - 1])):
            fits = np.flatnonzero(room[size:])
            if len(fits):
                at = size + int(fits[0])
                room[at] -= 1
                one = held[at].pop()
            else:
                at, one = capacity, {}
            one[size - 1] = one.get(size - 1, 0) + 1
            room[at - size] += 1
            held.setdefault(at - size, []).append(one)
    out = []
    for some in held.values():
        for one in some:
            p = np.zeros(len(left), np.int64)
            for i, n in one.items():
                p[i] = n
            out.append(p)
    return out


def plan(demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole-number uses: patterns (one a row) and how often each is used; together they hold exactly the demand."""
    patterns, x = column_generation(demand, capacity)
    left, chosen = demand.copy(), []
    for i in np.argsort(-x):
        p, n = patterns[i], int(x[i] + 1e-6)
        n = min([n, *(left[p > 0] // p[p > 0])])
        if n > 0:
            chosen.append((p, int(n)))
            left = left - n * p
    chosen += [(p, 1) for p in best_fit(left, capacity)]
    if not chosen:
        return np.zeros((0, len(demand)), np.int64), np.zeros(0, np.int64)
    return np.array([p for p, _ in chosen]), np.array([n for _, n in chosen])


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids): whole sequences from the start of each text, then a rest."""
    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokens.pieces(tokenizer, False, KEPT)
        for batch in batches:
            for at in range(0, batch.num_rows, 1500):
                part = batch.slice(at, 1500)
                ids, counts = model.encode(part.column(1))
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, end_id).astype("<u4")
                total = counts + 1
                n = -(-total // capacity)
                which = np.repeat(np.arange(len(total)), n)
                start = (np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)) * capacity
                length = np.minimum(capacity, total[which] - start)
                begin = (np.cumsum(total) - total)[which] + start
                crc = [zlib.crc32(ids[b : b + k]) for b, k in zip(begin, length)]
                out = [part.column(0).take(pa.array(which)), start, length, crc, total[which]]
                out = [out[0], *(pa.array(np.asarray(c, np.int64)) for c in out[1:])]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    offsets = np.append(begin, len(ids)).astype(np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, kind)


def assign(cut: DataFrame, capacity: int = CAPACITY, quantum: int = QUANTUM) -> DataFrame:
    """cut with sequence_id and offset. cut must be a written table: it is read more than once."""
    spark, classes = cut.sparkSession, capacity // quantum
    # Hashed chunks keep a frequent length class from being one task; their number bounds what the driver adds up.
    chunks = min(2048, max(64, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    size = F.ceil(F.col("length") / quantum).cast("int")
    ranked = cut.withColumn("_size", size).withColumn("_chunk", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(chunks)).cast("int"))
    # At most classes x chunks counts, both parameters; the driver adds them up.
    counted = ranked.groupBy("_size", "_chunk").count().collect()
    n = np.zeros((classes + 1, chunks), np.int64)
    for r in counted:
        n[r["_size"], r["_chunk"]] = r["count"]
    base = np.cumsum(n, axis=1) - n
    patterns, uses = plan(n[1:].sum(axis=1), classes)
    first = np.cumsum(uses) - uses
    # For each class, the ranks from which each pattern takes its items, how many in a use, and its first sequence.
    table: dict[int, tuple[list[int], list[int], list[int]]] = {}
    for c in range(classes):
        at = np.flatnonzero(patterns[:, c]) if len(patterns) else np.zeros(0, np.int64)
        took = patterns[at, c] * uses[at] if len(at) else at
        table[c + 1] = ((np.cumsum(took) - took).tolist(), patterns[at, c].tolist() if len(at) else [], first[at].tolist())
    shared = spark.sparkContext.broadcast((base, {k: tuple(map(np.array, v)) for k, v in table.items()}))
    order = Window.partitionBy("_size", "_chunk").orderBy("doc_id", "start", "ids_crc32")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, table = shared.value
        for b in batches:
            size, chunk, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("_size", "_chunk", "_rank"))
            rank = rank + base[size, chunk]
            sequence, slot = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for s in np.unique(size):
                mine = np.flatnonzero(size == s)
                starts, each, firsts = table[int(s)]
                k = np.searchsorted(starts, rank[mine], "right") - 1
                sequence[mine] = firsts[k] + (rank[mine] - starts[k]) // each[k]
                slot[mine] = (rank[mine] - starts[k]) % each[k]
            keep = [b.column(i) for i, name in enumerate(b.schema.names) if name[0] != "_"]
            names = [name for name in b.schema.names if name[0] != "_"]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(slot), pa.array(size)], names=[*names, "sequence_id", "_slot", "_size"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    dealt = ranked.withColumn("_rank", (F.row_number().over(order) - 1).cast("long")).mapInArrow(deal, f"{fields}, sequence_id long, _slot long, _size int")
    # A sequence has at most `capacity` pieces, so this window is bounded for every sequence.
    within = Window.partitionBy("sequence_id").orderBy(F.desc("_size"), "_slot").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("offset", F.coalesce(F.sum("length").over(within), F.lit(0)).cast("long")).drop("_slot", "_size")


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY, quantum: int = QUANTUM, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, (ids,) sequence_id, offset."""
    if capacity % quantum:
        raise ValueError("capacity must be a multiple of quantum")
    scratch.ship(docs.sparkSession)
    cut = pieces(docs, tokenizer, capacity, end_id, with_ids)
    if not with_ids:
        return assign(scratch.keep(cut, "pieces"), capacity, quantum)
    # The plan is made without the ids, which then cross one shuffle to their rows, by numbers that the written table fixes.
    cut = scratch.keep(cut.withColumn("piece", F.monotonically_increasing_id()), "pieces")
    return assign(cut.drop("ids"), capacity, quantum).join(cut.select("piece", "ids"), "piece").drop("piece")
