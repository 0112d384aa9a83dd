"""Score tables: per variant, per video, overall, and how they are reported."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import ALL_METRICS, CORE_METRICS, OPTIONAL_METRICS, TEMPORAL_METRICS


def present(df: DataFrame, metrics: Sequence[str]) -> list[str]:
    return [name for name in metrics if name in df.columns]


def means_by(rows: DataFrame, key: str, metrics: Sequence[str] = ALL_METRICS) -> DataFrame:
    """Mean of every metric per key, and over all rows under the key ``ALL``."""
    names = present(rows, metrics)
    sets = rows.groupingSets([[F.col(key)], []], F.col(key))
    label = F.when(F.grouping(key) == 1, F.lit("ALL")).otherwise(F.col(key).cast("string"))
    grouped = sets.agg(label.alias("_label"), *(F.avg(name).alias(f"_{name}") for name in names))
    return grouped.select(
        F.col("_label").alias(key), *(F.col(f"_{name}").alias(name) for name in names)
    )


def per_video(
    frames: DataFrame,
    ordinal: str,
    metrics: Sequence[str] = ALL_METRICS,
    flicker: DataFrame | None = None,
) -> DataFrame:
    """Mean metrics per video and variant; category, protocol and gain of the first frame."""
    names = present(frames, metrics)
    aggregates = [
        F.min_by("category", ordinal).alias("category"),
        F.count(F.lit(1)).alias("n_frames"),
        F.min_by("headline_protocol", ordinal).alias("headline_protocol"),
    ]
    if "exposure_gain" in frames.columns:
        first_gain = F.when(F.col("exposure_gain").isNotNull(), F.col(ordinal))
        aggregates.append(F.min_by("exposure_gain", first_gain).alias("exposure_gain"))
    aggregates += [F.avg(name).alias(name) for name in names]
    rows = frames.groupBy("video", "variant").agg(*aggregates)
    if flicker is None:
        return rows
    joined = rows.join(flicker.withColumn("_found", F.lit(True)), ["video", "variant"], "left")
    missing = F.raise_error(F.concat_ws(" ", F.lit("no flicker for"), "video", "variant"))
    found = F.when(F.col("_found"), F.lit(True)).otherwise(missing.cast("boolean"))
    return joined.where(found).drop("_found")


def overall(videos: DataFrame, metrics: Sequence[str] = ALL_METRICS) -> DataFrame:
    """Macro means over video rows per variant and for ``ALL``.

    A count of distinct protocols would send every protocol value; smallest and largest
    tell just as well whether there is only one.
    """
    names = present(videos, metrics)
    low, high = F.min("headline_protocol"), F.max("headline_protocol")
    label = F.when(F.grouping("variant") == 1, F.lit("ALL")).otherwise(F.col("variant"))
    grouped = videos.groupingSets([[F.col("variant")], []], F.col("variant")).agg(
        label.alias("_label"),
        F.count(F.lit(1)).alias("n_videos"),
        F.when(low == high, low).otherwise(F.lit("mixed")).alias("headline_protocol"),
        *(F.avg(name).alias(f"_{name}") for name in names),
    )
    return grouped.select(
        F.col("_label").alias("variant"),
        "n_videos",
        "headline_protocol",
        *(F.col(f"_{name}").alias(name) for name in names),
    )


def availability(
    probes: Mapping[str, object] | None = None, optional: bool = True, video_mode: bool = False
) -> dict[str, str | None]:
    """Metric to null, or to the reason it cannot be had. Each probe is called once.

    A probe is a callable that raises :class:`Unavailable` if its backend is missing; an
    optional metric without a probe has no backend here.
    """
    probes = probes or {}
    found: dict[str, str | None] = {name: None for name in CORE_METRICS}
    for name in OPTIONAL_METRICS:
        if not optional:
            found[name] = "optional metrics are disabled"
        elif name not in probes:
            found[name] = "no backend is registered"
        else:
            try:
                probes[name]()
                found[name] = None
            except Unavailable as problem:
                found[name] = problem.reason
    for name in TEMPORAL_METRICS:
        found[name] = None if video_mode else "requires video mode"
    return found


class Unavailable(RuntimeError):
    """A metric backend that cannot run, with the reason."""

    def __init__(self, metric: str, reason: str) -> None:
        super().__init__(f"{metric}: {reason}")
        self.metric, self.reason = metric, reason


def availability_rows(spark, found: Mapping[str, str | None]) -> DataFrame:
    rows = [
        (name, "available" if reason is None else f"unavailable: {reason}")
        for name, reason in found.items()
    ]
    return spark.createDataFrame(rows, "metric string, status string")


def with_reasons(
    rows: DataFrame, metrics: Sequence[str], found: Mapping[str, str | None]
) -> DataFrame:
    """Metric columns as text, null cells replaced by the reason where there is one.

    The reasons are a handful of constants per metric, so they need no join.
    """
    cells: dict[str, Column] = {}
    for name in metrics:
        value = F.col(name).cast("string") if name in rows.columns else F.lit(None).cast("string")
        reason = found.get(name)
        cells[name] = value if reason is None else F.coalesce(value, F.lit(f"unavailable: {reason}"))
    plain = [name for name in rows.columns if name not in metrics]
    return rows.select(*plain, *(cell.alias(name) for name, cell in cells.items()))


def report_lines(rows: DataFrame, label: str, metrics: Sequence[str]) -> DataFrame:
    """One table line per row, three decimals, ``-`` where a metric is missing."""
    cells = [F.coalesce(F.format_string("%.3f", F.col(m)), F.lit("-")) for m in metrics]
    missing = [F.when(F.col(m).isNull(), F.lit("-")).otherwise(c) for m, c in zip(metrics, cells)]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", F.col(label), *missing), F.lit(" |"))
    return rows.select(F.col(label), line.alias("line"))
