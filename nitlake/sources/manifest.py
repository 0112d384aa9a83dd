"""Manifests: JSON lines, an optional header line, records in file order."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import number_rows
from ..schemas import HEADER, MANIFEST, SHARD_KEYS

#: Lines of a split that are sorted together.
LINES = 1 << 14


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_line"),
    )
    return lines.where(F.trim("value") != "")


def _is_header(value: Column) -> Column:
    return F.coalesce(F.get_json_object(value, "$.type") == "header", F.lit(False))


def read_manifest(
    spark: SparkSession,
    path: str,
    schema: str = MANIFEST,
    ordinal: str | None = None,
    strict: bool = False,
) -> DataFrame:
    """Records without blank lines and headers.

    ``ordinal`` adds the place of a record in the manifest. Lines are numbered inside some thousands
    of lines of their file split and splits by name and offset, so that no task reads the whole manifest,
    or a whole split of it after the shuffle.
    ``strict`` makes a record without ``hdr_shard`` an error: shard records and older
    picture records must not be mixed.
    """
    lines = _lines(spark, path).where(~_is_header(F.col("value")))
    if strict:
        lost = F.raise_error(F.lit(f"{path} mixes shard records with older picture records"))
        lines = lines.where(
            F.when(F.get_json_object("value", "$.hdr_shard").isNull(), lost.cast("boolean"))
            .otherwise(F.lit(True))
        )
    if ordinal is not None:
        lines = number_rows(
            lines,
            ["_path", "_start", "_line"],
            # The line numbers of a split count on within their partition, from a multiple of 2^33.
            buckets=[F.struct("_path", "_start"), F.floor(F.col("_line") / LINES)],
            out=ordinal,
        )
    fields = [] if ordinal is None else [ordinal]
    return lines.select(*fields, F.from_json("value", schema).alias("_r")).select(*fields, "_r.*")


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """The header of a manifest: its first line if that is a header, else no row."""
    first = _lines(spark, path).orderBy("_path", "_start", "_line").limit(1)
    header = first.where(_is_header(F.col("value")))
    return header.select(F.from_json("value", HEADER).alias("_h")).select("_h.*")


def is_shard_manifest(spark: SparkSession, path: str) -> bool:
    """Whether the first record names shards and keys. Only that line comes to the driver."""
    records = _lines(spark, path).where(~_is_header(F.col("value")))
    first = records.orderBy("_path", "_start", "_line").select("value").limit(1).collect()
    return bool(first) and set(SHARD_KEYS) <= set(json.loads(first[0]["value"]))
