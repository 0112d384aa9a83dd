"""Report files of an evaluation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import reduce
from ..operators.metrics import ALL_METRICS, FRAME_METRICS
from .evaluate import Scores


def table_head(label: str, metrics: Sequence[str]) -> list[str]:
    return [f"| {label} | " + " | ".join(metrics) + " |", "|" + "---|" * (len(metrics) + 1)]


def table_foot(metrics: Sequence[str], found: Mapping[str, str | None]) -> list[str]:
    lost = [f"- {m}: unavailable: {found[m]}" for m in metrics if found.get(m) is not None]
    return ["", "Metric availability:", "", *lost] if lost else []


def shown_metrics(rows: DataFrame, found: Mapping[str, str | None]) -> list[str]:
    """Metrics that some row has, or whose absence has a reason; one row comes to the driver."""
    names = reduce.present(rows, ALL_METRICS)
    counts = rows.agg(*(F.count(n).alias(n) for n in names)).first()
    filled = {n for n in names if counts[n]}
    return [m for m in ALL_METRICS if m in filled or found.get(m) is not None]


def _markdown(rows: DataFrame, label: str, title: str, found, folder: str) -> None:
    """A table as text files: head, sorted lines, foot, written by Spark in that order."""
    spark = rows.sparkSession
    shown = shown_metrics(rows, found)
    for name in shown:
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("double"))
    lines = reduce.report_lines(rows, label, shown).select(
        F.lit(1).alias("part"), F.col(label).cast("string").alias("key"), "line"
    )
    fixed = [(0, f"{i:03d}", t) for i, t in enumerate(table_head(title, shown))]
    fixed += [(2, f"{i:03d}", t) for i, t in enumerate(table_foot(shown, found))]
    whole = spark.createDataFrame(fixed, "part int, key string, line string").unionByName(lines)
    whole.orderBy("part", "key").select("line").write.mode("overwrite").text(folder)


def write_report(scores: Scores, folder: str) -> None:
    """``per_frame``, ``per_video``, ``overall`` and ``availability`` as CSV, and two tables."""
    spark = scores.frames.sparkSession
    found = scores.availability
    tables = {
        "per_frame": reduce.with_reasons(scores.frames, FRAME_METRICS, found),
        "per_video": reduce.with_reasons(scores.videos, ALL_METRICS, found),
        "overall": reduce.with_reasons(scores.overall, ALL_METRICS, found),
        "availability": reduce.availability_rows(spark, found),
    }
    for name, table in tables.items():
        table.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")
    _markdown(scores.overall, "variant", "Variant", found, f"{folder}/summary.md")
    named = scores.videos.withColumn("label", F.concat_ws(" / ", "video", "variant"))
    _markdown(named, "label", "Video / variant", found, f"{folder}/per_video.md")
