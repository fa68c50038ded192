"""Token ids in a byte-aligned variable-length file format.

An id is replaced by its rank by frequency over all documents, so frequent ids have small values. A block holds runs of
documents in ascending doc_id: two bits for each value, four values a control byte, say how many bytes (1 to 4) the value
takes; the control bytes stand apart from the data bytes. A table of 256 rows gives, for each control byte, the lengths
and places of its four values, by which numpy decodes a block without a loop over values.

The container is a Parquet table of blocks (binary columns), since only Spark's writers reach every store; the ranks
stand beside it as a table of at most as many rows as the vocabulary.

Null or empty text counts as the end id alone. Rows with equal doc_id stay, next to each other. A null doc_id sorts first.
Any further columns are ignored. An empty table gives an empty file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch, tokens

#: Ids after which a block ends (with the document that reaches it).
BLOCK = 1 << 18
#: Bytes of text in a range of doc_id, and how many ranges there are at most (beyond that ranges grow).
PART_BYTES, MOST_PARTS, UNIT = 64_000_000, 20_000, 4096
#: Stands for a null doc_id.
LEAST = -(1 << 63)
_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) % 4 + 1).astype(np.int32)
_TOTAL = _LENGTHS.sum(axis=1, dtype=np.int32)
_PLACES = (np.cumsum(_LENGTHS, axis=1) - _LENGTHS).astype(np.int32)
_LONGEST = _LENGTHS.max(axis=1)


def encode(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, "<u4")
    n, width = len(values), max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    taken = np.ones((n, width), bool)
    codes = np.zeros(-(-n // 4) * 4, np.uint8)
    for k in range(1, width):
        taken[:, k] = values >= 1 << 8 * k
        codes[:n] += taken[:, k]
    control = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    return control.tobytes(), values.view(np.uint8).reshape(-1, 4)[:, :width][taken].tobytes()


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values."""
    c = np.frombuffer(control, np.uint8)
    # Values absent at the end have a length of one byte in the table, so the data are padded.
    d = np.frombuffer(data + b"\0" * 8, np.uint8)
    total = _TOTAL[c]
    at = ((np.cumsum(total, dtype=np.int32) - total)[:, None] + _PLACES[c]).ravel()[:n]
    out = d[at].astype(np.uint32)
    longest = int(_LONGEST[c].max(initial=1))
    length = _LENGTHS[c].ravel()[:n] if longest > 1 else None
    for k in range(1, longest):
        more = np.flatnonzero(length > k)
        out[more] |= d[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _tokenised(docs: DataFrame, tokenizer: str, end_id: int, cuts: list[int]) -> DataFrame:
    """_pid, doc_id, n_tokens, ids (compressed): _pid is the range of doc_id that the row belongs to.

    A doc_id that stands in several cuts has so many rows that they fill the ranges between them, dealt by the checksum
    of their ids. A task's last row has n_tokens 0, which no document has, and holds how often the task saw each id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, pack, edges = tokens.pieces(tokenizer, True), zstandard.ZstdCompressor(1), np.array(cuts, np.int64)
        seen = np.zeros(0, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 2500):
                part = batch.slice(at, 2500)
                ids, counts = model.encode(part.column(1))
                ids = np.insert(ids, np.cumsum(counts), end_id).astype("<u4")
                ends = np.cumsum(counts + 1)
                more = np.bincount(ids, minlength=len(seen))
                more[: len(seen)] += seen
                seen = more
                wide = 4 if ids.max(initial=0) > 0xFFFF else 2
                planes = [(ids >> np.uint32(8 * k)).astype(np.uint8) for k in range(wide)]
                head = bytes([wide])
                packed = [pack.compress(head + b"".join(p[x:y].tobytes() for p in planes)) for x, y in zip((ends - counts - 1).tolist(), ends.tolist())]
                key = part.column(0)
                value = key.fill_null(LEAST).to_numpy()
                pid, left = np.searchsorted(edges, value, "right"), np.searchsorted(edges, value, "left")
                for i in np.flatnonzero(pid - left > 1):
                    pid[i] = left[i] + 1 + zlib.crc32(packed[i]) % (pid[i] - left[i])
                yield pa.RecordBatch.from_arrays([pa.array(pid.astype(np.int32)), key, pa.array(counts + 1), pa.array(packed, pa.binary())], names=["_pid", "doc_id", "n_tokens", "ids"])
        task = TaskContext.get().partitionId() % (len(cuts) + 1)
        yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([None], pa.int64()), pa.array([0]), pa.array([pack.compress(seen.astype("<i8").tobytes())], pa.binary())], names=["_pid", "doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "_pid int, doc_id long, n_tokens long, ids binary")


def _ids(packed: bytes, unpack: zstandard.ZstdDecompressor) -> np.ndarray:
    """Ids of a document: their bytes stand plane by plane, which compresses better; the first byte counts the planes."""
    data = unpack.decompress(packed)
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 4), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u4").ravel()


def _cuts(docs: DataFrame, part_bytes: int) -> list[int]:
    """Bounds of ranges of doc_id with about equal bytes of text; an id with the bytes of several ranges stands in several.

    Every text counts once for each UNIT bytes. The bounds are at most MOST_PARTS numbers, whatever the input.
    """
    spark = docs.sparkSession
    weight = F.floor(F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) / UNIT).cast("int") + 1
    sized = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("id"), weight.alias("n"))
    total = sized.agg(F.sum("n")).first()[0] or 0
    parts = min(MOST_PARTS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total * UNIT // part_bytes)))
    if parts < 2 or not total:
        return []
    spread = sized.select(F.explode(F.array_repeat("id", F.col("n"))).alias("id"))
    return list(spread.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)], 10 * parts)).first()[0])


def write(docs: DataFrame, at: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, part_bytes: int = PART_BYTES) -> None:
    """Writes {at}/blocks and {at}/ranks. Each text is encoded once; ids cross one shuffle, to their range of doc_id. The
    files of {at}/blocks, by name, and the rows in them hold the documents in ascending doc_id order."""
    spark = docs.sparkSession
    scratch.ship(spark)
    cuts = _cuts(docs, part_bytes)
    stage = scratch.keep(_tokenised(docs, tokenizer, end_id, cuts), "stage", "uncompressed")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for x in b.column(0).to_pylist():
                seen = np.frombuffer(unpack.decompress(x), "<i8")
                some = np.flatnonzero(seen)
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], names=["id", "n"])

    # As many rows as ids in use: the vocabulary bounds what the driver and a broadcast hold.
    seen = stage.where("n_tokens = 0").select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    seen = sorted(((-r["n"], r["id"]) for r in seen))
    ranked = np.array([i for _, i in seen], np.int64)
    rank_of = np.zeros(int(ranked.max()) + 1 if len(ranked) else 1, np.uint32)
    rank_of[ranked] = np.arange(len(ranked))
    shared = spark.sparkContext.broadcast(rank_of)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, held, size, now, before = zstandard.ZstdDecompressor(), [], 0, None, 0

        def block() -> pa.RecordBatch:
            nonlocal before
            values = shared.value[np.concatenate([_ids(x[3], unpack) for x in held])]
            control, data = encode(values)
            docs, lengths = [x[1] for x in held], [x[2] for x in held]
            start, before = before, before + len(values)
            return pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int32()), pa.array([start], pa.int64()), pa.array([len(values)], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([control], pa.binary()), pa.array([data], pa.binary())],
                names=["part", "start_in_part", "n_ids", "doc_ids", "lengths", "control", "data"],
            )

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and (row[0] != now or size >= BLOCK):
                    yield block()
                    held, size = [], 0
                if row[0] != now:
                    now, before = row[0], 0
                held.append(row)
                size += row[2]
        if held:
            yield block()

    kind = "part int, start_in_part long, n_ids long, doc_ids array<long>, lengths array<long>, control binary, data binary"
    # A range is one task, in order, and its number that of its file.
    dealt = stage.where("n_tokens > 0").repartitionById(len(cuts) + 1, F.col("_pid")).sortWithinPartitions("_pid", "doc_id")
    dealt.mapInArrow(blocks, kind).write.option("compression", "snappy").parquet(f"{at}/blocks")
    spark.createDataFrame([(k, int(i)) for k, i in enumerate(ranked)], "rank long, id long").coalesce(1).write.parquet(f"{at}/ranks")


def read(spark: SparkSession, at: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of each document, from the files alone."""
    scratch.ship(spark)
    ranks = spark.read.parquet(f"{at}/ranks").collect()
    id_of = np.zeros(max(1, len(ranks)), "<u4")
    for r in ranks:
        id_of[r["rank"]] = r["id"]
    blocks = spark.read.parquet(f"{at}/blocks")
    # One total for each range of doc_id that the writer made.
    totals = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    base, before = {}, 0
    for part, n in totals:
        base[part] = before
        before += n
    shared = spark.sparkContext.broadcast((id_of, base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_of, base = shared.value
        for b in batches:
            for part, start, n, docs, lengths, control, data in zip(*(c.to_pylist() for c in b.columns)):
                ids = id_of[decode(control, data, n)]
                ends = np.cumsum(np.array(lengths, np.int64))
                begins = ends - lengths
                out = [pa.array(docs, pa.int64()), pa.array(base[part] + start + begins), pa.array(lengths, pa.int64()), pa.array([zlib.crc32(ids[x:y]) for x, y in zip(begins, ends)], pa.int64())]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.append(begins, ends[-1:]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    columns = blocks.select("part", "start_in_part", "n_ids", "doc_ids", "lengths", "control", "data")
    return columns.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
