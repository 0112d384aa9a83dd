"""Token ids in files of compressed bit planes.

A file is a Parquet table written by Spark, one record per segment: a run of whole documents in
ascending id order, of about SEGMENT ids together. A segment's ids are cut into blocks of BLOCK
ids. A block is transposed: plane b holds bit b of all its ids, eight to a byte, and each plane is
compressed with zstandard on its own, because the high planes of frequent ids are nearly constant.

Columns: ``part``, ``seq`` (the segment's place), ``first`` (its first document), ``doc_ids`` and
``doc_tokens`` (its documents and their ids' numbers), ``n_ids``, ``planes`` (per block),
``index`` (where each block's planes begin in ``payload``, and the end), ``payload``.
Spark's writer commits whole tasks, so a lost executor leaves no half file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir, stored
from . import tokens

BLOCK = 1 << 16
SEGMENT = 1 << 18
FORMAT = (
    "part int, seq int, first bigint, doc_ids array<bigint>, doc_tokens array<bigint>, n_ids bigint, "
    "planes array<int>, index array<bigint>, payload binary"
)


def squeeze(ids: np.ndarray) -> tuple[list[int], list[int], bytes]:
    """(planes per block, index, payload) of ids (unsigned, up to 32 bits)."""
    packer = zstandard.ZstdCompressor(level=3)
    planes, index, parts, at = [], [], [], 0
    for begin in range(0, len(ids), BLOCK):
        block = ids[begin : begin + BLOCK]
        planes.append(max(1, int(block.max()).bit_length()))
        for bit in range(planes[-1]):
            parts.append(packer.compress(np.packbits((block >> np.uint32(bit)).astype(np.uint8) & np.uint8(1)).tobytes()))
            index.append(at)
            at += len(parts[-1])
    return planes, [*index, at], b"".join(parts)


def unsqueeze(n_ids: int, planes: list[int], index: list[int], payload: bytes) -> np.ndarray:
    """The ids that :func:`squeeze` took."""
    unpacker = zstandard.ZstdDecompressor()
    out, held, k = np.zeros(n_ids, np.uint32), memoryview(payload), 0
    for i, count in enumerate(planes):
        block = out[i * BLOCK : (i + 1) * BLOCK]
        for bit in range(count):
            plane = unpacker.decompress(held[index[k] : index[k + 1]], max_output_size=BLOCK // 8)
            block |= np.unpackbits(np.frombuffer(plane, np.uint8), count=len(block)).astype(np.uint32) << np.uint32(bit)
            k += 1
    return out


def _segments(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path)
        part, seq = TaskContext.get().partitionId(), 0
        owners, sizes, held, total = [], [], [], 0

        def record() -> pa.RecordBatch:
            planes, index, payload = squeeze(np.concatenate(held))
            row = {"part": part, "seq": seq, "first": owners[0], "doc_ids": owners, "doc_tokens": sizes, "n_ids": total,
                   "planes": planes, "index": index, "payload": payload}
            return pa.RecordBatch.from_pylist([row], SCHEMA)

        for batch in batches:
            for owner, text in zip(batch.column("_id").to_pylist(), tokens.texts(batch, "_text"), strict=True):
                ids = np.append(encode(text), np.uint32(end))
                owners.append(owner)
                sizes.append(len(ids))
                held.append(ids)
                total += len(ids)
                if total >= SEGMENT:
                    yield record()
                    seq += 1
                    owners, sizes, held, total = [], [], [], 0
        if owners:
            yield record()

    return run


SCHEMA = pa.schema(
    [("part", pa.int32()), ("seq", pa.int32()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
     ("doc_tokens", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("planes", pa.list_(pa.int32())),
     ("index", pa.list_(pa.int64())), ("payload", pa.binary())]
)


def encoded(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None, end: int = 0) -> DataFrame:
    """Segments of all documents in ascending id order (nulls first; equal ids by text), to be written.

    A null text is empty and has the end id alone. A document is never cut between segments, so
    a segment holds one document at least, however long. Repeated rows are written again. Other
    columns are ignored.
    """
    rows = docs.select(F.col(id).cast("bigint").alias("_id"), F.col(text).alias("_text"))
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    placed = rows.repartitionByRange(parts, "_id").sortWithinPartitions("_id", "_text")
    return placed.mapInArrow(_segments(path or tokens.default_path(), end), FORMAT)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            ids = unsqueeze(row["n_ids"], row["planes"], row["index"], row["payload"])
            ends = np.cumsum(row["doc_tokens"])
            starts = ends - row["doc_tokens"]
            n = len(ends)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["part"]] * n, pa.int32()), pa.array([row["seq"]] * n, pa.int32()),
                    pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(row["doc_tokens"], pa.int64()),
                    pa.array([ids[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
                ],
                names=["part", "seq", "_id", "within", "n_tokens", "ids"],
            )


def decoded(files: DataFrame) -> DataFrame:
    """(part, seq, _id, within, n_tokens, ids) of every document, read back from the planes;
    ``ids`` are little-endian unsigned 32-bit integers."""
    return files.mapInArrow(_decoded, "part int, seq int, _id bigint, within bigint, n_tokens bigint, ids binary")


def starts(files: DataFrame) -> DataFrame:
    """(part, seq, before): the ids before each segment, from the index columns alone."""
    sizes = files.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # One row per file part: a few thousand rows, ordered in one task.
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("_parts"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    return sizes.withColumn("_in", inside).join(before, "part").select("part", "seq", (F.col("_parts") + F.col("_in")).alias("before"))


def file_digests(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None, end: int = 0) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the files that it was written to."""
    shared_dir(docs.sparkSession)
    files = stored(encoded(docs, id, text, path, end), "planes")
    found = decoded(files).select("part", "seq", "_id", "within", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return found.join(starts(files), ["part", "seq"]).select(
        F.col("_id").alias(id), (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32"
    )
