"""Shards of a target size: next-fit packing and renumbering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .numbering import number_rows

SHARD_BYTES = 1_000_000_000
# A writer packs about this many shards; more data means more writers, not longer ones.
SHARDS_PER_WRITER = 64


def with_writers(
    items: DataFrame,
    ordinal: str,
    nbytes: str,
    shard_bytes: int = SHARD_BYTES,
    per_writer: int = SHARDS_PER_WRITER,
) -> DataFrame:
    """Deal items out to writers in turn; the number of writers follows the total size."""
    wanted = F.ceil(F.sum(nbytes) / F.lit(float(shard_bytes * per_writer))).cast("bigint")
    writers = items.agg(F.greatest(F.lit(1).cast("bigint"), wanted)).scalar()
    return items.withColumn("writer", F.col(ordinal) % writers)


def _next_fit(sizes: np.ndarray, filled: int, target: int) -> tuple[np.ndarray, int]:
    """How many times a new shard was begun up to each item, and the bytes in the last one."""
    totals = np.cumsum(sizes)
    begun = np.zeros(len(sizes), dtype="int64")
    start, before, base, shard = 0, 0, filled, 0
    while start < len(sizes):
        room = target - base
        end = int(np.searchsorted(totals, before + room, side="right"))
        if base == 0:
            end = max(end, start + 1)  # an oversized item gets a shard of its own
        end = max(end, start)
        begun[start:end] = shard
        if end == len(sizes):
            return begun, int(base + totals[-1] - before)
        start, before, base = end, int(totals[end - 1]) if end else 0, 0
        shard += 1
    return begun, filled


def pack(
    items: DataFrame, ordinal: str, nbytes: str, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """Add ``shard``: per ``writer``, in ``ordinal`` order, a new shard when the next item
    would pass the target.

    Only ids and sizes pass through here. Rows of a writer arrive sorted, in batches, and
    all that is carried from batch to batch is the open shard.
    """
    if shard_bytes <= 0:
        raise ValueError("the shard target must be positive")
    slim = items.select("writer", ordinal, F.col(nbytes).cast("bigint").alias("_size"))
    laid = slim.repartition("writer").sortWithinPartitions("writer", ordinal)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        writer, shard, filled = None, 0, 0
        for batch in batches:
            begun_all = []
            for name, rows in batch.groupby("writer", sort=False):
                if name != writer:
                    writer, shard, filled = name, 0, 0
                begun, filled = _next_fit(rows["_size"].to_numpy(), filled, shard_bytes)
                begun_all.append(begun + shard)
                shard = int(begun_all[-1][-1])
            yield batch.drop(columns="_size").assign(
                shard=np.concatenate(begun_all) if begun_all else np.zeros(0, "int64")
            )

    packed = laid.mapInPandas(scan, f"writer bigint, {ordinal} bigint, shard bigint")
    return items.join(packed, ["writer", ordinal])


def duplicate_keys(packed: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once in one shard."""
    counts = packed.groupBy("writer", "shard", key).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") > 1)


def renumber(packed: DataFrame, first: Column) -> DataFrame:
    """Final shard numbers from ``first`` on, in (writer, shard) order.

    One row per shard is numbered: there are as many as there are target sizes in the data.
    Packing is done once; its ids and sizes are written before they are read again.
    """
    packed = cut(packed)
    shards = packed.select("writer", "shard").distinct()
    final = number_rows(shards, ["writer", "shard"], buckets=[F.col("writer")], out="final_shard")
    final = final.withColumn("final_shard", F.col("final_shard") + first)
    return packed.join(final, ["writer", "shard"])


def next_shard(names: DataFrame, column: str, kind: str) -> DataFrame:
    """One row, ``next``: the number after the highest one in names like ``kind-00012``."""
    digits = F.regexp_extract(F.col(column), rf"^{kind}-([0-9]+)(\.[^.]*)?$", 1)
    number = F.when(digits != "", digits).cast("bigint")
    return names.agg((F.coalesce(F.max(number), F.lit(-1).cast("bigint")) + 1).alias("next"))


