"""Row numbers that do not pull a whole group, or a whole table, into one task.

``row_number() over (partition by key order by x)`` sorts each key in a single task. Here
rows are first put into order-preserving buckets; buckets are counted with map-side
combining, the small bucket counts give every bucket its first number, and only rows of
one bucket are sorted together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def _before(df: DataFrame, inside: list[str], by: str, count: str, out: str) -> DataFrame:
    window = (
        Window.partitionBy(*inside)
        .orderBy(by)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return df.withColumn(out, F.coalesce(F.sum(count).over(window), F.lit(0).cast("bigint")))


def number_rows(
    df: DataFrame,
    order: Sequence[str | Column],
    keys: Sequence[str] = (),
    buckets: Sequence[Column] | None = None,
    out: str = "n",
) -> DataFrame:
    """Add ``out`` = 0, 1, 2, ... within ``keys`` by ``order``, which must have no ties.

    ``buckets`` are one or two expressions, coarse then fine, that never decrease along
    ``order``: a day of a timestamp, thousands of an ordinal, the leading digits of a hash.
    Without them Spark's range partitioning supplies the bucket; that assignment is written
    to the shared folder first, so that counting and numbering see the same one.
    """
    keys = list(keys)
    if buckets is None:
        ranged = df.repartitionByRange(*keys, *order).withColumn("_b0", F.spark_partition_id())
        df, names = cut(ranged), ["_b0"]
    else:
        names = [f"_b{level}" for level in range(len(buckets))]
        df = df.withColumns(dict(zip(names, buckets)))

    counts = df.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("_c"))
    if len(names) == 1:
        starts = _before(counts, keys, names[0], "_c", "_s")
    else:
        fine = _before(counts, [*keys, names[0]], names[1], "_c", "_s1")
        coarse = counts.groupBy(*keys, names[0]).agg(F.sum("_c").alias("_c"))
        coarse = _before(coarse, keys, names[0], "_c", "_s0").drop("_c")
        starts = fine.join(coarse, [*keys, names[0]]).withColumn("_s", F.col("_s0") + F.col("_s1"))
    starts = starts.select(*keys, *names, "_s")

    inside = Window.partitionBy(*keys, *names).orderBy(*order)
    numbered = df.withColumn("_r", F.row_number().over(inside))
    joined = numbered.join(starts, [*keys, *names])
    return joined.withColumn(out, F.col("_s") + F.col("_r") - 1).drop(*names, "_r", "_s")


def every_nth(df: DataFrame, number: str, n: int) -> DataFrame:
    """Rows 0, n, 2n, ... by a number column."""
    if n < 1:
        raise ValueError("subsample must be at least 1")
    return df.where(F.col(number) % n == 0)


def first_rows(df: DataFrame, number: str, n: int | None) -> DataFrame:
    """Rows whose number is below ``n``; all rows where there is no cap."""
    return df if n is None else df.where(F.col(number) < n)
