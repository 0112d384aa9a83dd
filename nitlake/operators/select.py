"""Which videos, frames and variants take part."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reference_list(
    rows: DataFrame, hash_column: str, filter_column: str | None, filter_value: str
) -> DataFrame:
    """Distinct trimmed hashes of the rows that match; if none match, of all rows."""
    if filter_column:
        match = F.coalesce(F.trim(F.col(filter_column).cast("string")), F.lit("")) == filter_value
        any_match = rows.select(match.alias("_m")).agg(F.max("_m")).scalar()
        rows = rows.where(match | ~F.coalesce(any_match, F.lit(False)))
    return rows.select(F.trim(F.col(hash_column).cast("string")).alias("video")).distinct()


def allowed_only(tasks: DataFrame, allowed: DataFrame | None, key: str = "video") -> DataFrame:
    return tasks if allowed is None else tasks.join(allowed.select(key), key, "left_semi")


def without(tasks: DataFrame, excluded: DataFrame | None, key: str = "video") -> DataFrame:
    return tasks if excluded is None else tasks.join(excluded.select(key), key, "left_anti")


def both_lists(one: DataFrame | None, other: DataFrame | None) -> DataFrame | None:
    if one is None or other is None:
        return one if other is None else other
    return one.select("video").intersect(other.select("video"))


def drawn(
    candidates: DataFrame, group: str, name: str, count: int, seed: int, salt: str = ""
) -> DataFrame:
    """``count`` names per group, the same ones whatever the order of the rows.

    Names are ranked by a keyed hash. Spark cuts each task's rows to ``count`` per group
    before the shuffle, so one group that holds most rows is no hot spot.
    """
    ticket = F.sha2(F.concat_ws(":", F.lit(f"{seed}"), F.col(group), F.col(name), F.lit(salt)), 256)
    window = Window.partitionBy(group).orderBy("_ticket", name)
    ranked = candidates.select(group, name, ticket.alias("_ticket"))
    ranked = ranked.withColumn("_r", F.row_number().over(window))
    return ranked.where(F.col("_r") <= count).select(group, name)


def enough(candidates: DataFrame, group: str, count: int) -> None:
    """Raise if a group has fewer than ``count`` candidates; at most five are listed."""
    if count <= 0:
        raise ValueError("the number of names to draw must be positive")
    short = candidates.groupBy(group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < count)
    found = short.limit(5).collect()
    if found:
        listed = ", ".join(f"{row[group]} has {row['n']}" for row in found)
        raise ValueError(f"{count} are required, but {listed}")


def hold_out(tasks: DataFrame, group: str, name: str, count: int, seed: int) -> DataFrame:
    """Tasks without the ones drawn for the holdout."""
    held = drawn(tasks, group, name, count, seed)
    return tasks.join(held, [group, name], "left_anti")


def variants_only(df: DataFrame, variants: Sequence[str] | None) -> DataFrame:
    return df.where(F.col("variant").isin(*variants)) if variants else df


def first_per_bucket(df: DataFrame, keys: Sequence[str], time: Column, fps: float) -> DataFrame:
    """Frame-rate resampling: the first row of each 1/fps interval of ``time`` seconds."""
    if fps <= 0:
        raise ValueError("fps must be positive")
    slot = F.floor(time * F.lit(float(fps))).cast("bigint")
    everything = F.struct(time.alias("_t"), F.struct(*df.columns).alias("_row"))
    grouped = df.groupBy(*keys, slot.alias("slot"))
    firsts = grouped.agg(F.min(everything).alias("_first"))
    payload = [c for c in df.columns if c not in keys]
    return firsts.select(*keys, "slot", *(F.col(f"_first._row.{c}").alias(c) for c in payload))


def too_short(selected: DataFrame, least: int = 2) -> DataFrame:
    """Videos with fewer selected frames than a sequence needs."""
    counts = selected.groupBy("video").agg(F.count(F.lit(1)).alias("n_frames"))
    return counts.where(F.col("n_frames") < least)
