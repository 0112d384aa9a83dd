"""Writing manifests. Spark's commit makes a written folder appear whole or not at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pair import sorted_manifest
from ..schemas import CONVENTIONS, HEADER_FIELDS


def json_line(columns: list[str]) -> Column:
    """A record as one JSON line, keys in order, nulls kept."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def header_row(spark: SparkSession, peak_nits: float = 1000.0) -> DataFrame:
    """The conventions of a corpus as one row."""
    row = {**CONVENTIONS, "type": "header", "hdr_mastering_peak_nits": float(peak_nits)}
    names = ("type", *HEADER_FIELDS)
    return spark.range(1).select(*(F.lit(row[name]).alias(name) for name in names))


def write_manifest(
    records: DataFrame, folder: str, header: DataFrame | None = None, mode: str = "overwrite"
) -> None:
    """``folder/records`` and ``folder/header``, JSON lines; records in manifest order."""
    ordered = sorted_manifest(records)
    ordered.select(json_line(records.columns).alias("value")).write.mode(mode).text(
        f"{folder}/records"
    )
    if header is not None:
        header.select(json_line(header.columns).alias("value")).coalesce(1).write.mode(
            "overwrite"
        ).text(f"{folder}/header")
