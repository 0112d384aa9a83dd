"""First-order recurrences along a sequence of any length."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def smooth(
    df: DataFrame,
    keys: Sequence[str],
    number: str,
    values: Sequence[str],
    alpha: float,
) -> DataFrame:
    """Exponential smoothing: applied = alpha * previous applied + (1 - alpha) * current.

    ``number`` counts 0, 1, 2, ... within a key and row 0 is taken as it is. The columns in
    ``values`` are replaced. The recurrence is linear, so a sequence is cut into chunks:
    each chunk is summed by itself, and what earlier chunks leave behind is added with its
    decayed weight. No task holds more than a chunk of one sequence.
    """
    if not 0.0 <= alpha < 1.0:
        raise ValueError("alpha must lie in [0, 1)")
    if alpha == 0.0:
        return df
    share = F.when(F.col(number) == 0, F.lit(1.0)).otherwise(F.lit(1.0 - alpha))
    fed = df.withColumns({value: F.col(value) * share for value in values})
    return _scanned(fed, list(keys), number, values, alpha)


# Weights up to e^230 apart are summed in one window, far from the limits of a double; below
# e^-745 a weight is zero as a double.
_SPAN, _NOTHING = 230.0, 745.2
#: Chunk ends that reach this far or less are added up directly.
_DIRECT = 64


def _scanned(df: DataFrame, keys: list[str], number: str, values: Sequence[str], alpha: float) -> DataFrame:
    """y = x + alpha * previous y for the columns in ``values``, along ``number`` within a key."""
    chunk = max(1, min(1024, int(_SPAN / -math.log(alpha))))
    df = df.withColumns(
        {
            "_g": F.floor(F.col(number) / chunk).cast("bigint"),
            "_i": (F.col(number) % chunk).cast("double"),
        }
    )
    grow = F.pow(F.lit(alpha), -F.col("_i"))
    inside = Window.partitionBy(*keys, "_g").orderBy(number)
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns(
        {
            value: F.sum(F.col(value) * grow).over(running) * F.pow(F.lit(alpha), F.col("_i"))
            for value in values
        }
    )
    ends = df.where(F.col("_i") == chunk - 1).select(*keys, "_g", *values)
    carried = _carried(ends, keys, values, -math.log(alpha) * chunk)
    joined = df.join(carried, [*keys, "_g"], "left")
    fade = F.pow(F.lit(alpha), F.col("_i") + 1)
    return joined.withColumns(
        {
            value: F.col(value) + F.coalesce(F.col(f"_p_{value}"), F.lit(0.0)) * fade
            for value in values
        }
    ).drop("_g", "_i", *(f"_p_{value}" for value in values))


def _carried(ends: DataFrame, keys: list[str], values: Sequence[str], fall: float) -> DataFrame:
    """What all chunks before chunk ``_g`` leave behind, each decayed by e^-fall per chunk. Chunk
    ends are such a sequence themselves, so where many of them still weigh, they are scanned alike."""
    names = [F.col(value).alias(f"_p_{value}") for value in values]
    reach = int(_NOTHING / fall) + 1
    if reach > _DIRECT:
        sums = _scanned(ends.withColumnRenamed("_g", "_chunk"), keys, "_chunk", values, math.exp(-fall))
        return sums.select(*keys, (F.col("_chunk") + 1).alias("_g"), *names)
    ahead = ends.withColumn("_j", F.explode(F.sequence(F.lit(1), F.lit(reach))))
    decay = F.exp((1 - F.col("_j")).cast("double") * fall)
    return (
        ahead.withColumn("_g", F.col("_g") + F.col("_j"))
        .groupBy(*keys, "_g")
        .agg(*(F.sum(F.col(value) * decay).alias(f"_p_{value}") for value in values))
    )
