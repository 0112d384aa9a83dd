"""Packing documents into token sequences: first-fit decreasing, group by group.

Documents are cut at multiples of the sequence length; what is left over is packed. Pieces are
dealt at random into groups of a bounded size that do not know of each other. In a group they are
taken longest first, and each goes to the first sequence that has room: a tournament tree over the
sequences' room finds it in logarithmic time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir, stored
from . import tokens

LENGTH = 2048
#: Pieces of a group, on average.
GROUP = 20_000


class Tournament:
    """Room of sequences 0, 1, 2, ... as the leaves of a tree whose nodes hold the most room below."""

    def __init__(self, sequences: int, room: int):
        self.leaves = 1 << max(0, sequences - 1).bit_length()
        self.most = [room] * (2 * self.leaves)

    def first(self, length: int) -> int:
        """The first sequence with room for ``length``; takes that room."""
        most, node = self.most, 1
        while node < self.leaves:
            node *= 2
            if most[node] < length:
                node += 1
        found = node - self.leaves
        most[node] -= length
        while node > 1:
            node //= 2
            left, right = most[2 * node], most[2 * node + 1]
            best = left if left >= right else right
            if most[node] == best:
                break
            most[node] = best
        return found


def first_fit_decreasing(lengths: np.ndarray, room: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece; pieces come longest first, equal ones in their order."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, filled = Tournament(len(lengths), room), [0] * len(lengths)
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        at = tree.first(length)
        sequence[i], offset[i] = at, filled[at]
        filled[at] += length
    return sequence, offset


def _pieces(path: str, end: int, length: int, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path)
        made = 0
        for batch in batches:
            rows = []
            for owner, text in zip(batch.column("_id").to_pylist(), tokens.texts(batch, "_text"), strict=True):
                ids = np.append(encode(text), np.uint32(end))
                for start in range(0, len(ids), length):
                    piece = ids[start : start + length].tobytes()
                    rows.append((owner, start, len(piece) // 4, zlib.crc32(piece), len(ids), made, piece if keep else None))
                    made += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int64()] * 6 + [pa.binary()], strict=True)],
                names=["_id", "start", "length", "ids_crc32", "doc_tokens", "made", "ids"],
            )

    return run


def pieces(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None, end: int = 1,
           length: int = LENGTH, keep: bool = False) -> DataFrame:
    """(_id, start, length, ids_crc32, doc_tokens, made, ids) of all pieces; ``ids`` (little-endian
    32-bit integers) are null unless ``keep``."""
    rows = docs.select(F.col(id).cast("bigint").alias("_id"), F.col(text).alias("_text"))
    shape = "_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, made bigint, ids binary"
    return rows.mapInArrow(_pieces(path or tokens.default_path(), end, length, keep), shape)


def _placed(length: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["_id", "start", "made"], ignore_index=True)
        sequence, offset = first_fit_decreasing(frame["length"].to_numpy(), length)
        return frame.assign(sequence=sequence, offset=offset).drop(columns=["made"])

    return run


def packed(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None, end: int = 1,
           length: int = LENGTH, group: int = GROUP, keep: bool = False) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]), a row per piece.

    Every document ends with ``end``; a null text is empty and is that id alone. Each id lies in
    one piece and each piece in one sequence of at most ``length`` ids, gapless from offset 0.
    Groups are drawn by a hash of piece and place of reading, so a row that is repeated ever so
    often is spread over all groups. Other columns are ignored. No row, no sequence.
    """
    shared_dir(docs.sparkSession)
    cut = stored(pieces(docs, id, text, path, end, length, keep), "pieces")
    groups = max(1, -(-cut.count() // group))
    drawn = cut.withColumn("_group", F.pmod(F.xxhash64(F.lit("pack"), "_id", "start", "made"), F.lit(groups)))
    wanted = ["_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if keep else [])]
    shape = "_group bigint, _id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    shape += (", ids binary" if keep else "") + ", sequence bigint, offset bigint"
    placed = drawn.select("_group", *wanted, "made").groupBy("_group").applyInPandas(_placed(length), shape)
    number = F.shiftleft("_group", 32).bitwiseOR(F.col("sequence"))
    return placed.select(F.col("_id").alias(id), *wanted[1:5], number.alias("sequence_id"), "offset", *wanted[5:])


def sequences(placed: DataFrame, length: int = LENGTH, pad: int = 0) -> DataFrame:
    """(sequence_id, ids, filled): the sequences themselves from pieces that kept their ids.

    Padded with ``pad`` to ``length``, except at a power of two, which stays as long as it is."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    rows = placed.groupBy("sequence_id").agg(F.array_join(F.transform(parts, lambda p: F.hex(p["ids"])), "").alias("_hex"))
    filled = (F.length("_hex") / 8).cast("int")
    exact = filled.bitwiseAND(filled - 1) == 0
    blank = F.repeat(F.lit(int(pad).to_bytes(4, "little").hex()), F.when(exact, 0).otherwise(length - filled))
    return rows.select("sequence_id", F.unhex(F.concat("_hex", blank)).alias("ids"), filled.alias("filled"))
