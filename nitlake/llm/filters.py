"""A key filter of bounded size that tasks can hold: a bitmap built by Spark."""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A filter never has more bits (8 MB). Beyond what that can tell apart, more keys pass that need not;
#: whatever passes is joined exactly afterwards, so results do not depend on it.
MOST_BITS = 26


def key_filter(keys: DataFrame, key: str, rows: int) -> Broadcast:
    """Bits of well mixed 64-bit keys, sixteen per key where the bound allows, sent to all tasks.

    Spark ors the bits word by word, so the driver sees at most 2^20 words however many keys there are.
    """
    bits = int(np.clip(int(np.ceil(np.log2(max(rows, 1)))) + 4, 10, MOST_BITS))
    place = F.shiftrightunsigned(F.col(key), 64 - bits)
    words = keys.select(
        F.shiftrightunsigned(place, 6).cast("int").alias("word"),
        F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(63)).cast("int")).alias("bit"),
    ).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    made = np.zeros(1 << (bits - 6), np.uint64)
    for batch in words.toArrow().to_batches():
        made[batch.column("word").to_numpy()] = batch.column("bits").to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(made)


def passes(made: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys (64-bit unsigned) the filter lets through: all that were put in, and a few others."""
    bits = int(np.log2(len(made))) + 6
    place = keys >> np.uint64(64 - bits)
    return (made[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) != 0
