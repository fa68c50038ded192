"""Join of documents whose sets of word five-grams have a Jaccard similarity of at least 0.8.

A MinHash LSH forest proposes the pairs. A text's signature in a tree is a path of DEPTH levels, kept as one long whose
order is the order of the tree's trie, so a node of the trie is a prefix of the path and a run of the sorted paths. All
paths are sorted once, over ranges that split even equal paths; what the last run of a range shares with the next ranges
is added up on the driver, a few numbers a range. A text matches by the shortest useful prefix that at most CROWD texts
share, else by the whole path. Short prefixes meet a pair at the threshold with a high chance, so texts whose prefixes all
stay short are done after the first trees; texts in crowded parts of the trie, which match by longer prefixes, go on with
further trees until the chance that a pair at the threshold is met reaches the target recall. Of two texts the one that
ends first accounts for the pair.

Texts that meet are verified by exact shingle sets where they meet; a Bloom filter of their MD5 leaves the texts that
meet none where they are, and what it lets through in error falls out of a join. The texts of a node are one unit of work,
split into blocks of a bounded number of texts and bytes of which every two are compared. Nodes with the same texts are
one. Whole paths that more than CROWD texts share tie their texts to dense groups first, each of which is compared once,
block by block, whatever the number of trees in which its texts meet. A pair that meets more than once counts at its first
node alone, so no list of pairs is ever written: a unit returns each text's number of links and a forest of ties.

Nodes of the graph are distinct texts, by MD5. A null text counts as empty; texts without words link only to equal texts.
Rows with one doc_id but different texts are different documents, and rows with a null doc_id are documents like all
others. Further columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from . import graph, scratch, textkernel, tokens

THRESHOLD, RECALL = 0.8, 0.9999
#: Bits of the levels of a path, 63 in all; prefixes of fewer levels than LEAST are never tried, so these levels have most
#: bits: unrelated texts must not meet by chance, as their pairs grow with the square of the table.
BITS, LEAST = (13, 13, 13, 6, 6, 6, 6), 3
DEPTH = len(BITS)
#: Texts that may share a prefix before it is made longer.
CROWD = 32
BLOCK, BLOCK_BYTES = 128, 4_000_000
#: Bits of the Bloom filter for each text that meets others, and at most: beyond, more texts move in vain, none is lost.
BLOOM, BLOOM_MOST = 16, 1 << 26
_MOST_TREES = 48


@dataclass(frozen=True)
class Forest:
    """Path levels in use, the least prefix, trees for texts with short prefixes, all trees."""

    threshold: float
    depth: int
    least: int
    first: int
    trees: int


def trees_for(threshold: float, depth: int, recall: float) -> int:
    """How many trees meet a pair at the threshold with the target chance, if prefixes have this length."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**depth) - 1e-9)) if threshold < 1 else 1


def forest(threshold: float = THRESHOLD, recall: float = RECALL) -> Forest:
    depth = max((d for d in range(1, DEPTH + 1) if trees_for(threshold, d, recall) <= _MOST_TREES), default=1)
    least = min(LEAST, depth)
    return Forest(threshold, depth, least, trees_for(threshold, least, recall), trees_for(threshold, depth, recall))


def _paths(h: np.ndarray, counts: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """For each text with shingles and each tree its path; DEPTH levels long, the last ones 0 if fewer are in use."""
    full = counts[counts > 0]
    starts = np.cumsum(full) - full
    low = (h >> np.uint64(32)).astype(np.uint32)
    factors = np.random.default_rng(11).integers(0, 1 << 31, (trees, depth), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    out = np.zeros((len(full), trees), np.int64)
    if not len(full):
        return out
    for t in range(trees):
        path = np.zeros(len(full), np.int64)
        for f, bits in zip(factors[t], BITS):
            least = np.minimum.reduceat(low * f, starts)
            least = (least ^ (least >> np.uint32(15))) * np.uint32(0x9E3779B1)
            path = path << bits | (least >> np.uint32(32 - bits)).astype(np.int64)
        out[:, t] = path << sum(BITS[depth:])
    return out


def signatures(docs: DataFrame, shape: Forest) -> DataFrame:
    """doc_id, key (of the text), bytes and paths (one a tree; none without shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        for batch in batches:
            buf, off = textkernel.raw(batch.column(1))
            for a, b in textkernel.steps(off, 1 << 19):
                own, at = buf[off[a] : off[b]], off[a : b + 1] - off[a]
                h, counts = textkernel.shingles(own, at)
                data = own.tobytes()
                keys = [hashlib.md5(data[x:y]).digest() for x, y in zip(at[:-1], at[1:])]
                places = np.concatenate([[0], np.cumsum(np.where(counts > 0, shape.trees, 0))]).astype(np.int32)
                paths = pa.ListArray.from_arrays(pa.array(places), pa.array(_paths(h, counts, shape.trees, shape.depth).ravel()))
                columns = [batch.column(0).slice(a, b - a), pa.array(keys, pa.binary()), pa.array(np.diff(at)), paths]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "bytes", "paths"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, key binary, bytes long, paths array<long>")


def _runs(rows: DataFrame, shape: Forest) -> DataFrame:
    """rows (node, t, path) sorted over ranges; of those that may meet others: n, the length of the run of each prefix within
    the range, least, the least node of the whole path's, first and last, how many of the prefixes stand in the first and
    the last run of the range, which other ranges may go on with, and edge: 1 for the first row, 2 for the last, 3 for both.
    A range's numbers are held at once, some 100 bytes a row; no text is."""
    shifts = [sum(BITS[d:]) for d in range(shape.least, shape.depth + 1)]
    names = ["part", "node", "t", "path", "n", "least", "first", "last", "edge"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
        if not held:
            return
        t, path, node = (np.concatenate(c) for c in zip(*held))
        held.clear()
        n = np.zeros((len(t), len(shifts)), np.int64)
        first, last, edge = (np.zeros(len(t), np.int64) for _ in range(3))
        for k, shift in enumerate(shifts):
            prefix = path >> shift
            starts = np.flatnonzero(np.append(True, (prefix[1:] != prefix[:-1]) | (t[1:] != t[:-1])))
            lengths = np.diff(np.append(starts, len(t)))
            n[:, k] = np.repeat(lengths, lengths)
            first[: lengths[0]], last[starts[-1] :] = k + 1, k + 1
        least = np.repeat(node[starts], lengths)
        edge[0] += 1
        edge[-1] += 2
        some = np.flatnonzero((n[:, 0] > 1) | (first > 0) | (last > 0))
        part = np.full(len(some), TaskContext.get().partitionId(), np.int64)
        for at in range(0, len(some), 50_000):
            x = some[at : at + 50_000]
            counts = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(shifts)), pa.array(n[x].ravel()))
            columns = [part[at : at + 50_000], node[x], t[x].astype(np.int64), path[x], counts, least[x], first[x], last[x], edge[x]]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)

    order = ["t", "path", "node"]
    kind = ", ".join(f"{c} array<long>" if c == "n" else f"{c} long" for c in names)
    return rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, kind)


def _across(edges: list[Row], shifts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For the first and the last run of each range: the length over all ranges by prefix, and the least node of the whole path's."""
    ends: dict[int, list[Row]] = {}
    for r in edges:
        both = ends.setdefault(r["part"], [r, r])
        for side in (0, 1):
            if r["edge"] >> side & 1:
                both[side] = r
    total = np.zeros((max(ends, default=0) + 1, 2, len(shifts)), np.int64)
    least = np.zeros(total.shape[:2], np.int64)
    for k, shift in enumerate(shifts):
        runs: list[list] = []
        for p in sorted(ends):
            for side, r in enumerate(ends[p]):
                if not runs or runs[-1][0] != (r["t"], r["path"] >> shift):
                    runs.append([(r["t"], r["path"] >> shift), r["least"], 0, []])
                # A last run that is the first one as well counts once.
                runs[-1][2] += 0 if side and r["first"] > k else r["n"][k]
                runs[-1][3].append((p, side))
        for _, low, size, members in runs:
            for p, side in members:
                total[p, side, k], least[p, side] = size, low
    return total, least


def _nodes(rows: DataFrame, shape: Forest, crowd: int) -> DataFrame:
    """rows (node, t, path) -> node, bucket, depth, n, least: the nodes of the tries at which texts meet others, how many
    texts stand there and, if that is a whole path, the least of them."""
    shifts = [sum(BITS[d:]) for d in range(shape.least, shape.depth + 1)]
    runs = scratch.keep(_runs(rows, shape), "runs")
    edges = runs.where("edge > 0").select("part", "edge", "t", "path", "n", "least", "first").collect()
    shared = rows.sparkSession.sparkContext.broadcast(_across(edges, shifts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, low = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            part, node, t, path, least, first, last = (b.column(c).to_numpy() for c in ("part", "node", "t", "path", "least", "first", "last"))
            n = b.column("n").flatten().to_numpy().reshape(len(part), len(shifts))
            level = np.arange(len(shifts))
            n = np.where(first[:, None] > level, total[part, 0], np.where(last[:, None] > level, total[part, 1], n))
            least = np.where(first == len(shifts), low[part, 0], np.where(last == len(shifts), low[part, 1], least))
            few = n <= crowd
            at = np.where(few.any(axis=1), few.argmax(axis=1), len(shifts) - 1)
            n, depth = n[np.arange(len(at)), at], at + shape.least
            prefix = (path >> np.array(shifts)[at]).astype(np.uint64)
            bucket = textkernel.mix(prefix ^ textkernel.mix((t * (DEPTH + 1) + depth).astype(np.uint64))).view(np.int64)
            met = pa.RecordBatch.from_arrays([pa.array(c) for c in (node, bucket, depth, n, least)], names=["node", "bucket", "depth", "n", "least"])
            yield met.filter(pa.array(n > 1))

    found = runs.select("part", "node", "t", "path", "n", "least", "first", "last").mapInArrow(run, "node long, bucket long, depth long, n long, least long")
    return scratch.keep(found, "met")


def meetings(texts: DataFrame, shape: Forest, crowd: int) -> DataFrame:
    """node, bucket, n, least: where texts (node, paths) meet, after the first trees and, for texts with longer prefixes, all."""

    def exploded(nodes: DataFrame, a: int, b: int) -> DataFrame:
        return nodes.select("node", F.posexplode(F.slice("paths", a + 1, b - a)).alias("t", "path")).withColumn("t", F.col("t") + a)

    out = _nodes(exploded(texts, 0, shape.first), shape, crowd)
    if shape.first < shape.trees:
        crowded = scratch.keep(out.where(F.col("depth") > shape.least).select("node").distinct(), "crowded")
        if not crowded.isEmpty():
            more = scratch.keep(texts.select("node", "paths").join(crowded, "node", "left_semi"), "crowded_paths")
            out = out.unionByName(_nodes(exploded(more, shape.first, shape.trees), shape, crowd))
    return out.select("node", "bucket", "n", "least")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The number of common elements of each two sets (sorted, distinct)."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, which, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[which] > 1
    owner, which = owner[shared], which[shared]
    _, which = np.unique(which, return_inverse=True)
    out = np.zeros((n, n), np.float32)
    width = 4096
    order = np.argsort(which, kind="stable")
    owner, which = owner[order], which[order]
    for at in range(0, int(which[-1]) + 1 if len(which) else 0, width):
        a, b = np.searchsorted(which, (at, at + width))
        m = np.zeros((n, width), np.float32)
        m[owner[a:b], which[a:b] - at] = 1
        out += m @ m.T
    return out.astype(np.int64)


def _verify(threshold: float):
    """dense, unit, i, j, side, node, copies, place, buckets, text, sorted by the first four -> node, links, hub."""

    def group(rows: list[tuple]) -> tuple[list, list, list]:
        dense, unit, i, j = rows[0][:4]
        side, node, copies, place = (np.array([r[k] for r in rows]) for k in (4, 5, 6, 7))
        apart = ~np.eye(len(rows), dtype=bool)
        if i != j:
            apart &= side[:, None] != side[None, :]
        if not dense:
            # Pairs of one dense group, or with a common bucket before this one, are compared there.
            apart &= (place[:, None] != place[None, :]) | (place < 0)[:, None]
            before = [np.array([b for b in r[8] if b < unit], np.int64) for r in rows]
            if sum(map(len, before)):
                apart &= overlaps(before) == 0
        if not apart.any():
            return [], [], []
        sets = textkernel.sets(pa.array([r[9] for r in rows], pa.string()))
        sizes = np.array([len(s) for s in sets])
        common = overlaps(sets)
        linked = apart & (common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-9)
        links = linked @ copies
        order = np.sort(node)
        label = np.searchsorted(order, node)
        while True:
            new = np.minimum(label, np.where(linked, label[None, :], len(node)).min(axis=1))
            if (new == label).all():
                break
            label = new
        some = np.flatnonzero(links > 0)
        return node[some].tolist(), links[some].tolist(), order[label][some].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        held: list[tuple] = []
        out: tuple[list, list, list] = ([], [], [])

        def flush() -> None:
            if held:
                for a, b in zip(out, group(held)):
                    a += b
                held.clear()

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["node", "links", "hub"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and row[:4] != held[0][:4]:
                    flush()
                held.append(row)
            if len(out[0]) > 10_000:
                yield batch()
                out = ([], [], [])
        flush()
        yield batch()

    return run


def _key(text) -> Column:
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


def _slots(keys: list[bytes], bits: int) -> np.ndarray:
    """Two places in a Bloom filter for each key."""
    return np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2) & np.uint64(bits - 1)


def _bloom(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of the MD5 in the column key: 64-bit words, a power of two of them; it crosses the driver."""
    bits = min(BLOOM_MOST, 1 << max(16, (keys.count() * BLOOM).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(_slots(b.column(0).to_pylist(), bits))
            if len(at):
                word, starts = np.unique(at >> np.uint64(6), return_index=True)
                held = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), starts)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (word, held)], names=["word", "bits"])

    found = keys.select("key").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def _picked(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """key and text of the rows of docs whose text's key is one of wanted's, and of a few others."""
    shared = docs.sparkSession.sparkContext.broadcast(_bloom(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            buf, off = textkernel.raw(batch.column(0))
            data = buf.tobytes()
            keys = [hashlib.md5(data[x:y]).digest() for x, y in zip(off[:-1], off[1:])]
            at = _slots(keys, 64 * len(words))
            held = (words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).all(axis=1)
            if held.any():
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), batch.column(0)], names=["key", "text"]).filter(pa.array(held))

    return docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, "key binary, text string")


def _with_roots(found: DataFrame) -> DataFrame:
    """node, root with a row for each root as well."""
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())


def _blocks(members: DataFrame, sizes: DataFrame, dense: bool, block: int, block_bytes: int) -> DataFrame:
    """members (unit, node, ...) with dense, nb (blocks of the unit) and k (the block of the node)."""
    # Written: what a hot unit's many nodes meet has one row, in a join that adaptive execution can split.
    units = members.join(sizes, "node").groupBy("unit").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("bytes") / block_bytes)).cast("int").alias("nb"))
    units = scratch.keep(units, "units")
    return members.join(units, "unit").withColumns({"dense": F.lit(dense), "k": F.pmod(F.xxhash64("node"), F.col("nb")).cast("int")})


def classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, crowd: int = CROWD, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """signed: doc_id and key of each row; and one row a distinct text: key, node, id (least doc_id), copies, root (a node
    that stands for its class), class_id (least doc_id of the class, null if it has none), links (rows of other texts)."""
    scratch.ship(docs.sparkSession)
    shape = forest(threshold, recall)
    signed = scratch.keep(signatures(docs, shape), "signatures")
    texts = signed.groupBy("key").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("paths").alias("paths"), F.max("bytes").alias("bytes"))
    # The written table fixes these numbers, which have no collisions as hashes would.
    texts = scratch.keep(texts.withColumn("node", F.monotonically_increasing_id()), "texts")
    sizes = texts.select("node", "bytes")
    met = meetings(texts, shape, crowd)
    packed = met.where(F.col("n") > crowd).select(F.col("node").alias("a"), F.col("least").alias("b"))
    groups = _with_roots(graph.components(packed))
    thin = met.where(F.col("n") <= crowd).join(groups.withColumnRenamed("root", "place"), "node", "left").select("node", "bucket", F.coalesce("place", F.lit(-1)).alias("place"))
    # Nodes of the tries with the same texts are one, and those within one dense group are left out.
    same = thin.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"), F.min("place").alias("p"), F.max("place").alias("q"))
    chosen = scratch.keep(same.where("p < q or p < 0").groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket"), "chosen")
    members = scratch.keep(thin.join(chosen, "bucket"), "members")
    # At most one bucket a tree.
    buckets = members.groupBy("node").agg(F.collect_list("bucket").alias("buckets"))
    light = _blocks(members.join(buckets, "node").withColumnRenamed("bucket", "unit"), sizes, False, block, block_bytes)
    dense = _blocks(groups.select(F.col("root").alias("unit"), "node"), sizes, True, block, block_bytes).withColumns({"place": F.lit(-1).cast("long"), "buckets": F.array().cast("array<long>")})
    placed = scratch.keep(light.unionByName(dense).join(texts.select("node", "key", "copies"), "node"), "placed")
    found = _picked(docs, placed).groupBy("key").agg(F.first("text").alias("text"))
    # A text goes to the pair of its block with each block of its unit.
    dealt = placed.join(found, "key").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(
        "dense", "unit", F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"), (F.col("k") > F.col("o")).cast("int").alias("side"), "node", "copies", "place", "buckets", "text"
    )
    dealt = dealt.repartition("dense", "unit", "i", "j").sortWithinPartitions("dense", "unit", "i", "j")
    checked = scratch.keep(dealt.mapInArrow(_verify(threshold), "node long, links long, hub long"), "checked")
    roots = _with_roots(graph.components(checked.select(F.col("node").alias("a"), F.col("hub").alias("b"))))
    least = scratch.keep(roots.join(texts.select("node", "id"), "node").groupBy("root").agg(F.min("id").alias("class_id")), "least_ids")
    linked = checked.groupBy("node").agg(F.sum("links").alias("links")).join(roots, "node").join(least, "root")
    out = texts.select("key", "node", "id", "copies").join(linked, "node", "left")
    named = {"root": F.coalesce("root", "node"), "class_id": F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("class_id")), "links": F.coalesce("links", F.lit(0))}
    return signed.select("doc_id", "key"), scratch.keep(out.withColumns(named), "classes")


def join(docs: DataFrame, threshold: float = THRESHOLD, with_class: bool = False, **options) -> DataFrame:
    """One row for each row of docs: doc_id, class_id (the least doc_id of its class, null if it has none), n_links (other
    rows at or above the threshold, copies counted each), n_copies (rows with this very text), and with with_class also
    class_key, which tells classes apart where one doc_id stands in several."""
    signed, texts = classes(docs, threshold, **options)
    texts = texts.select("key", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"), *[F.col("root").alias("class_key")] * with_class)
    return signed.join(texts, "key").drop("key")


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of docs of which one stays for each class: that with the least doc_id (a null one only if there is no
    other), of several such that whose text has the least MD5; of rows equal in both any one. All columns as they were.
    """
    _, texts = classes(docs, threshold, **options)
    first = texts.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "key")).alias("first"))
    def numbered(i: Column, key: Column) -> dict[str, Column]:
        return {"_id": F.coalesce(i, F.lit(0)), "_null": i.isNull(), "key": key}

    own = ["_id", "_null", "key"]
    kept = scratch.keep(first.select(*[c.alias(n) for n, c in numbered(F.col("first.id"), F.col("first.key")).items()]), "kept")
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    rows = rows.withColumns(numbered(F.col(names["doc_id"]).cast("long"), _key(F.col(names["text"]))))
    # Texts cross one shuffle, repeated rows combined before it, and meet the kept ones where that leaves them.
    rows = rows.dropDuplicates(own).join(kept, own)
    return rows.select(*[F.col(n).alias(c) for c, n in names.items()])


SQL = f"""
WITH RECURSIVE {textkernel.shingle_sql("documents", "doc_id", "s")},
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
link AS (SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE c >= {THRESHOLD} * (p.n + q.n - c) - 1e-9
    UNION SELECT x.doc_id, y.doc_id FROM documents x JOIN documents y ON coalesce(x.text, '') = coalesce(y.text, '') AND x.doc_id <> y.doc_id),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
root AS (SELECT a, min(b) AS least FROM reach GROUP BY a), links AS (SELECT a, count(*) AS n FROM link GROUP BY a),
copies AS (SELECT coalesce(text, '') AS t, count(*) AS n FROM documents GROUP BY coalesce(text, ''))
SELECT doc_id, least(doc_id, coalesce(root.least, doc_id)) AS class_id, coalesce(links.n, 0) AS n_links, copies.n AS n_copies
FROM documents LEFT JOIN root ON root.a = doc_id LEFT JOIN links ON links.a = doc_id JOIN copies ON copies.t = coalesce(text, '')
"""
