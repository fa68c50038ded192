"""Benchmark items inside documents, by size-partitioned MinHash containment search with exact verification.

A short item inside a long document has a tiny Jaccard similarity, so signatures of whole documents would need
thousands of hashes. Instead the items are partitioned by size (powers of two of their number of word five-grams), and
each partition keeps, of every item, the least hashes of its shingle set: as many as a document may miss at this size
and threshold, plus one. A document that contains the stated share of an item must then share one of these hashes,
whatever the order of hashes: no document is missed. Every shingle of every document is looked up, and each candidate
is verified by the exact share of the item's shingles in the document's set.

Distinct item texts are handled in blocks of a bounded number of characters (one item may be longer), so what is
broadcast never grows with the benchmark; each block is one pass over the documents.

Words and shingles: see textkernel. Null texts count as empty; an item without words is in no document. An item of
fewer than five words matches only a document of just these words. Rows repeated in either table, or with a null or
repeated id, are kept as rows. An empty table on either side gives no matches, and clean() then keeps all documents.
Further columns are ignored by matches(), also if they are named like outputs, and kept by clean().

With folded, texts are also compared without letter case and without marks at the ends of words (textkernel.folded), and
items of fewer than five words are found as runs of their own length anywhere in a document. This adds matches and takes
none away; counts of a pair are of the words as they stand if these alone make it a match. The SQL knows plain words
only, so op7_decontamination, which it defines, is not folded; decontamination_folded and the pipeline are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, textkernel, tokens

THRESHOLD = 0.8
#: Characters of benchmark text in one broadcast.
BLOCK_CHARS = 32_000_000


def index(texts: list[str | None], threshold: float = THRESHOLD) -> dict:
    """Arrays: the sketch hashes (sorted) with the items that own them, and the sets of all items end to end."""
    sets = textkernel.sets(pa.array(texts, pa.string()))
    hashes, owners = [], []
    for k, s in enumerate(sets):
        if not len(s):
            continue
        bound = (1 << len(s).bit_length()) - 1
        missed = int(np.floor((1 - threshold) * bound + 1e-9))
        least = s[: missed + 1]
        hashes.append(least)
        owners.append(np.full(len(least), k))
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    o = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    order = np.argsort(h, kind="stable")
    short = {}
    n = textkernel.words(*textkernel.raw(pa.array(texts, pa.string())))[2]
    for size in range(1, textkernel.SHINGLE):
        own = np.flatnonzero(n == size)
        if len(own):
            run = np.array([sets[k][0] for k in own])
            by = np.argsort(run, kind="stable")
            short[size] = (run[by], own[by])
    return {"hashes": h[order], "owners": o[order], "short": short, "sets": np.concatenate(sets) if sets else h, "starts": np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)}


def _met(keys: np.ndarray, owners: np.ndarray, h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Rows (text, item), sorted and distinct, of the texts that have one of the sorted keys."""
    none = np.zeros((0, 2), np.int64)
    if not len(keys) or not len(h):
        return none
    first = np.searchsorted(keys, h)
    hit = np.flatnonzero(keys[np.minimum(first, len(keys) - 1)] == h)
    if not len(hit):
        return none
    doc = np.repeat(np.arange(len(counts)), counts)[hit]
    n = np.searchsorted(keys, h[hit], "right") - first[hit]
    item = owners[np.repeat(first[hit], n) + textkernel.spread(n)]
    width = np.int64(owners.max() + 1)
    return np.stack(np.divmod(np.unique(np.repeat(doc, n) * width + item), width), axis=1)


def search(made: dict, h: np.ndarray, counts: np.ndarray, threshold: float) -> Iterator[tuple[int, int, int, int]]:
    """Text, item, common shingles, item's shingles: of pairs at or above the threshold."""
    ends = np.cumsum(counts)
    at, own = -1, h
    for d, k in _met(made["hashes"], made["owners"], h, counts).tolist():
        if d != at:
            at, own = d, np.unique(h[ends[d] - counts[d] : ends[d]])
        wanted = made["sets"][made["starts"][k] : made["starts"][k + 1]]
        place = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
        common = int((own[place] == wanted).sum())
        if common >= threshold * len(wanted) - 1e-9:
            yield d, k, common, len(wanted)


def runs(made: dict, buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """As search(): of the items of fewer than five words that stand somewhere in a text."""
    for size, (keys, owners) in made["short"].items():
        for d, k in _met(keys, owners, *textkernel.shingles(buf, off, size)).tolist():
            yield d, k, 1, 1


def found(made: list[dict], texts: pa.Array, threshold: float) -> Iterator[dict[tuple[int, int], tuple[int, int]]]:
    """(text, item): (common shingles, item's shingles), a step of texts at a time. made: one index of the items as they are, and for folded one of the folded items."""
    for a, b, h, counts in textkernel.batches(texts):
        out = {(d + a, k): (c, n) for d, k, c, n in search(made[0], h, counts, threshold)}
        if len(made) > 1:
            own = texts.slice(a, b - a)
            for m, t in zip(made, (own, textkernel.folded(own))):
                buf, off = textkernel.raw(t)
                more = [*search(m, *textkernel.shingles(buf, off), threshold)] if m is not made[0] else []
                for d, k, c, n in more + [*runs(m, buf, off)]:
                    out.setdefault((d + a, k), (c, n))
        yield out


def indexes(texts: list[str | None], threshold: float, folded: bool) -> list[dict]:
    both = [texts, textkernel.folded(pa.array(texts, pa.string())).to_pylist()]
    return [index(t, threshold) for t in both[: 1 + folded]]


def _blocks(texts: DataFrame, block_chars: int) -> list[tuple[int, int]]:
    """Ranges of buckets (of _bucket, 0 to n) whose distinct item texts have at most block_chars characters together; a
    bucket beyond that, which holds an item of such a length, stands alone. The last pair is (n, n)."""
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1024, -(-16 * chars // block_chars))
    sizes = {r["b"]: r["chars"] for r in texts.groupBy(F.pmod(F.xxhash64("text"), F.lit(n)).alias("b")).agg(F.sum(F.length("text")).alias("chars")).collect()}
    out, start, held = [], 0, 0
    for b in sorted(sizes):
        if held and held + sizes[b] > block_chars:
            out.append((start, b))
            start, held = b, 0
        held += sizes[b]
    return [*out, (start, n), (n, n)]


def _shared(docs: DataFrame, benchmark: DataFrame, threshold: float, block_chars: int, folded: bool) -> Iterator:
    """For each block of distinct item texts, a broadcast of its indexes and of the texts' keys."""
    spark = docs.sparkSession
    scratch.ship(spark)
    texts = scratch.keep(benchmark.select(F.col("text").cast("string").alias("text")).where("text is not null").distinct(), "items")
    *blocks, (n, _) = _blocks(texts, block_chars)
    for a, b in blocks:
        bucket = F.pmod(F.xxhash64("text"), F.lit(n))
        rows = texts.where((bucket >= a) & (bucket < b)).select("text", F.xxhash64("text", F.md5("text")).alias("key")).orderBy("key").toArrow()
        yield spark.sparkContext.broadcast((indexes(rows.column("text").to_pylist(), threshold, folded), rows.column("key").to_pylist()))


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_chars: int = BLOCK_CHARS, folded: bool = False) -> DataFrame:
    """doc_id, item_id, n_common, n_item, containment: of each document and item at or above the threshold."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = "doc_id long, key long, n_common long, n_item long, containment double"
    out = None
    for shared in _shared(docs, benchmark, threshold, block_chars, folded):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            tokens.forget()
            made, names = shared.value
            for batch in batches:
                for pairs in found(made, batch.column(1), threshold):
                    if pairs:
                        d, i, c, n = map(np.array, zip(*(p + v for p, v in pairs.items())))
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(pa.array(d)), pa.array([names[x] for x in i], pa.int64()), pa.array(c), pa.array(n), pa.array(c / n)],
                            names=["doc_id", "key", "n_common", "n_item", "containment"],
                        )

        part = texts.mapInArrow(run, kind)
        out = part if out is None else out.unionByName(part)
    # Items with one text are searched for once; here each gets its row.
    text = F.col("text").cast("string")
    items = benchmark.where(text.isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64(text, F.md5(text)).alias("key"))
    return out.join(items, "key").select("doc_id", "item_id", "n_common", "n_item", "containment")


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, folded: bool = False, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs that contain no item; all columns as they were. Every row is judged by its own text, so null and
    repeated doc_id do not matter, and nothing is shuffled."""
    out = docs
    for shared in _shared(docs, benchmark, threshold, block_chars, folded):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            tokens.forget()
            made, _ = shared.value
            for batch in batches:
                kept = np.ones(batch.num_rows, bool)
                for pairs in found(made, batch.column(batch.schema.get_field_index("text")).cast(pa.string()), threshold):
                    kept[[d for d, _ in pairs]] = False
                yield batch.filter(pa.array(kept))

        out = out.mapInArrow(run, docs.schema)
    return out


SQL = f"""
WITH {textkernel.shingle_sql("documents", "doc_id", "d")}, {textkernel.shingle_sql("benchmark", "item_id", "b")},
n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id),
c AS (SELECT doc_id, item_id, count(*) AS n_common FROM d JOIN b USING (g) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_common, n_item, CAST(n_common AS DOUBLE) / n_item AS containment FROM c JOIN n USING (item_id) WHERE n_common >= {THRESHOLD} * n_item - 1e-9
"""
