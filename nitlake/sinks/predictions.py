"""Inputs, predictions and references as pictures, with a manifest to score them again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import padded, safe_variant
from .manifest import json_line
from .png import to_png, write_files

# Fields of a record that go on into the manifest where the record has them.
KEPT = ("id", "video", "frame_index", "variant", "category",
        "content_id", "track", "tmo", "crf", "source_dataset")


def write_predictions(frames: DataFrame, folder: str, method: str) -> DataFrame:
    """Write three pictures per row and the manifest; returns the manifest records.

    ``frames`` has ``ordinal``, ``variant``, ``height``, ``width`` and planes ``sr sg sb``
    (8 bits), ``pr pg pb`` and ``tr tg tb`` (16 bits) of one size.
    """
    stem = F.concat(padded(F.col("ordinal"), 8), F.lit("_"), safe_variant(F.col("variant")))
    named = frames.withColumn("name", F.concat(stem, F.lit(".png")))
    for letter, part, depth in (
        ("s", "inputs", 8), ("p", "predictions", 16), ("t", "references", 16)
    ):
        planes = named.select(
            "name", "height", "width", *(F.col(letter + c).alias(c) for c in "rgb")
        )
        written = write_files(to_png(planes, depth, depth == 16), f"{folder}/{part}")
        written.write.format("noop").mode("overwrite").save()
    kept = [name for name in KEPT if name in frames.columns]
    records = named.select(
        "ordinal",
        *kept,
        F.lit(method).alias("method"),
        F.concat(F.lit("inputs/"), "name").alias("input"),
        F.concat(F.lit("predictions/"), "name").alias("prediction"),
        F.concat(F.lit("references/"), "name").alias("reference"),
    )
    fields = [name for name in records.columns if name != "ordinal"]
    lines = records.orderBy("ordinal").select(json_line(fields).alias("value"))
    lines.write.mode("overwrite").text(f"{folder}/predictions_manifest")
    return records.select(*fields)
