"""A keyed order of the numbers from 0 to n that needs no sort.

A number below ``a * b`` is a pair of a part below ``a`` and a part below ``b``. A round adds a keyed
hash of one part to the other, so that every round, and all of them, map pairs one to one. The product
is the next above ``n``; what a number in [0, n) leaves it by, it follows until it is back inside, which
keeps the mapping one to one (cycle walking). So the place of a row follows from its number alone.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import draws
from ..session import cut
from .attach import attach

ROUNDS = 4


def sides(n: int) -> tuple[int, int]:
    """``a`` and ``b`` whose product is at least ``n`` and less than ``n + a``; ``a`` is the root, rounded up."""
    a = math.isqrt(n - 1) + 1 if n else 1
    return a, max(-(-n // a), 1)


def _once(df: DataFrame, at: str, n: int, seed: str, out: str, inverse: bool) -> DataFrame:
    """All rounds once; ``out`` lies below ``a * b``."""
    a, b = sides(n)
    df = df.withColumns({"_low": F.col(at) % a, "_high": F.floor(F.col(at) / F.lit(a))})
    for turn in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
        known, other = ("_low", "_high") if inverse else ("_high", "_low")
        drawn = draws.ticket(f"{seed}:{turn}", F.col(known))
        moved = F.col(other) - drawn if inverse else F.col(other) + drawn
        df = df.withColumns({other: F.col(known), known: F.pmod(moved, F.lit(b if turn % 2 else a))})
    return df.withColumn(out, F.lit(a) * F.col("_high") + F.col("_low")).drop("_low", "_high")


def _exits(spark: SparkSession, n: int, seed: str, inverse: bool) -> DataFrame:
    """(_from, _exit): where a walk that has come to ``_from``, outside [0, n), gets back inside.

    There are fewer rows than the root of ``n``, rounded up. Steps double each time around; what is
    outside after that goes around in a circle that no walk from inside can come to.
    """
    a, b = sides(n)
    outside = spark.range(n, a * b).withColumnRenamed("id", "_from")
    outside = cut(_once(outside, "_from", n, seed, "_exit", inverse))
    for _ in range((a * b - n).bit_length()):
        if outside.where(F.col("_exit") >= n).isEmpty():
            break
        further = outside.select(F.col("_from").alias("_exit"), F.col("_exit").alias("_further"))
        walked = outside.join(further, "_exit", "left")
        outside = cut(walked.select("_from", F.coalesce("_further", "_exit").alias("_exit")))
    return outside.where(F.col("_exit") < n)


def permuted(df: DataFrame, at: str, n: int, seed: int | str, out: str, inverse: bool = False) -> DataFrame:
    """Add ``out``, the place of the number ``at`` in an order of 0, 1, ... n - 1 that ``seed`` names.

    No row is moved: nothing is sorted or shuffled. ``inverse`` goes from the place to the number.
    A number that is null or not in [0, n) is an error; it would share a place with another.
    """
    if n < 0:
        raise ValueError("there is no order of fewer than 0 numbers")
    a, b = sides(n)
    message = F.concat(F.lit(f"not a number from 0 to {n - 1}: "), F.coalesce(F.col(at).cast("string"), F.lit("null")))
    checked = F.when(F.col(at).between(0, n - 1), F.col(at)).otherwise(F.raise_error(message).cast("bigint"))
    df = _once(df.withColumn("_at", checked), "_at", n, str(seed), out, inverse).drop("_at")
    if a * b == n:
        return df
    exits = _exits(df.sparkSession, n, str(seed), inverse).withColumnRenamed("_from", out)
    found = attach(df, exits, [out], "left")
    return found.withColumn(out, F.coalesce("_exit", out)).drop("_exit")
