"""Exact quantiles of groups of any size.

Spark's exact ``percentile`` gathers every distinct value of a group in one task. That is
right for groups of a bounded size, and only they go that way. A larger group is narrowed
by counting: values fall into a fixed set of order-preserving buckets, the counts say in
which bucket the wanted rank lies, and the next pass looks only at rows of that bucket.
After two passes a sliver of the group is left, whose equal values are merged before it is
sorted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .attach import BROADCAST_ROWS

# Groups with more rows than this are narrowed.
GATHERED = 1_000_000
OCTAVE = 1024
SLICES = 4096


def _octave_bucket(value: Column) -> Column:
    """Never decreases with the value; ``OCTAVE`` steps to each power of two.

    The infinities and NaN, which Spark orders last, have outermost buckets of their own. Never
    null, so that no null filter is derived and pushed below the value.
    """
    size = F.floor(F.log2(F.abs(value)) * F.lit(OCTAVE)).cast("bigint") + F.lit(1100 * OCTAVE)
    outer = F.lit(4000 * OCTAVE).cast("bigint")
    infinite = F.lit(float("inf"))
    bucket = (
        F.when(F.isnan(value), outer + 1)
        .when(value == infinite, outer)
        .when(value == -infinite, -outer)
        .when(value > 0, size)
        .when(value < 0, -size)
    )
    return F.coalesce(bucket, F.lit(0).cast("bigint"))


def _slice_bucket(value: Column) -> Column:
    share = (value - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    index = F.least(F.floor(share * F.lit(SLICES)), F.lit(SLICES - 1).cast("bigint"))
    split = F.when(F.col("_hi") > F.col("_lo"), index)
    return F.coalesce(split, F.lit(0).cast("bigint"))


def _ranks(sizes: DataFrame, probabilities: Sequence[float], discrete: bool) -> DataFrame:
    """One row per wanted order statistic: ``_q`` which quantile, ``_w`` its weight."""
    wanted = []
    for index, p in enumerate(probabilities):
        place = F.lit(float(p)) * (F.col("_n") - 1)
        if discrete:
            low = F.greatest(F.ceil(F.lit(float(p)) * F.col("_n")) - 1, F.lit(0))
            pairs = [(low, F.lit(1.0))]
        else:
            low = F.floor(place)
            share = place - low
            pairs = [(low, 1 - share), (low + 1, share)]
        wanted += [
            F.struct(
                F.lit(index).alias("_q"),
                rank.cast("bigint").alias("_k"),
                weight.cast("double").alias("_w"),
            )
            for rank, weight in pairs
        ]
    spread = sizes.select("*", F.inline(F.array(*wanted)))
    # The upper neighbour of an exact hit has weight zero and may not exist.
    return spread.where(F.col("_w") > 0).drop("_n")


def _placed(counts: DataFrame, keys: list[str], by: str) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("_c").over(window), F.lit(0).cast("bigint"))
    return counts.withColumn("_s", start)


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Sequence[float],
    names: Sequence[str],
    discrete: bool = False,
    gathered: int = GATHERED,
    empty: bool = False,
) -> DataFrame:
    """One row per key with the named quantiles of ``value``; keys must not be null.

    Linear interpolation between neighbours by default; ``discrete`` takes the lowest value
    that reaches the probability, so 0.5 gives the lower median. Null values are left out,
    infinities are values, NaN is one above all others. A key without any value has no row, or
    with ``empty`` one of nulls. ``gathered`` bounds the rows of one task's group.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("_v"))
    # One pass over the keys alone decides the plan: most data has no group that large.
    # There is at most one large group per ``gathered`` rows.
    sizes = df.select(*keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    large = cut(sizes.where(F.col("_n") > gathered).select(*keys))
    found = large.count()
    if not found:
        return _gathered(rows, keys, probabilities, names, discrete, empty)
    # Each large group is met by at most two rows per quantile in the joins that follow.
    few = found * 2 * len(probabilities) <= BROADCAST_ROWS
    hint = F.broadcast if few else (lambda side: side)
    large = hint(large)
    direct = _gathered(rows.join(large, keys, "left_anti"), keys, probabilities, names, discrete, empty)
    hot = rows.join(large, keys, "left_semi")
    narrowed = _narrowed(hot, keys, probabilities, names, discrete, hint)
    if empty:
        narrowed = large.join(narrowed, keys, "left")
    return direct.unionByName(narrowed)


def _gathered(
    rows: DataFrame,
    keys: list[str],
    probabilities: Sequence[float],
    names: Sequence[str],
    discrete: bool,
    empty: bool,
) -> DataFrame:
    kind = "percentile_disc" if discrete else "percentile_cont"
    found = rows.groupBy(*keys).agg(
        *(
            F.expr(f"{kind}({float(p)!r}D) WITHIN GROUP (ORDER BY _v)").alias(name)
            for p, name in zip(probabilities, names)
        ),
        F.count("_v").alias("_c"),
    )
    return (found if empty else found.where(F.col("_c") > 0)).drop("_c")


def _narrowed(
    rows: DataFrame,
    keys: list[str],
    probabilities: Sequence[float],
    names: Sequence[str],
    discrete: bool,
    hint: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    rows = rows.withColumn("_b", _octave_bucket(F.col("_v")))
    # Nulls are left out by counting values and not by a filter: a filter would be pushed
    # down to the scan and compute the value a second time.
    edges = [F.count("_v").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]

    first = rows.groupBy(*keys, "_b").agg(*edges).where(F.col("_c") > 0)
    sizes = first.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    ranks = _ranks(sizes, probabilities, discrete)
    inside = (F.col("_k") >= F.col("_s")) & (F.col("_k") < F.col("_s") + F.col("_c"))
    aimed = _placed(first, keys, "_b").join(ranks, keys).where(inside)
    aimed = aimed.withColumn("_k", F.col("_k") - F.col("_s")).drop("_s", "_c")

    # Second pass: only rows of an aimed bucket, cut into slices between its extremes.
    bounds = aimed.select(*keys, "_b", "_lo", "_hi").distinct()
    near = rows.join(hint(bounds), [*keys, "_b"]).withColumn("_d", _slice_bucket(F.col("_v")))
    near = near.drop("_lo", "_hi")
    second = near.groupBy(*keys, "_b", "_d").agg(F.count("_v").alias("_c"))
    aimed = _placed(second, [*keys, "_b"], "_d").join(
        aimed.drop("_lo", "_hi"), [*keys, "_b"]
    ).where(inside)
    aimed = aimed.withColumn("_k", F.col("_k") - F.col("_s")).drop("_s", "_c")

    # Last pass: the few rows of an aimed slice, equal values merged before sorting.
    slices = aimed.select(*keys, "_b", "_d").distinct()
    last = near.join(hint(slices), [*keys, "_b", "_d"]).groupBy(*keys, "_b", "_d", "_v")
    last = last.agg(F.count("_v").alias("_c")).where(F.col("_c") > 0)
    found = _placed(last, [*keys, "_b", "_d"], "_v").join(aimed, [*keys, "_b", "_d"]).where(inside)
    return found.groupBy(*keys).agg(
        *(
            F.sum(F.when(F.col("_q") == index, F.col("_v") * F.col("_w"))).alias(name)
            for index, name in enumerate(names)
        )
    )
