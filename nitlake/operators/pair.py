"""Pairing of HDR and SDR sides, degradation grids and manifest tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.codes import CRF_LEVELS
from ..functions.tone import TONE_OPERATORS
from .numbering import number_rows

MANIFEST_ORDER = ("source_dataset", "video", "frame", "tmo", "crf")
MANIFEST_COLUMNS = (
    "hdr_shard", "hdr_key", "sdr_shard", "sdr_key", "video",
    "frame", "tmo", "crf", "split", "source_dataset",
)


def native_pairs(hdr: DataFrame, sdr: DataFrame, key: str = "relative") -> DataFrame:
    """Rows of both sides that share a relative path."""
    return hdr.join(sdr, key)


def native_mismatch(hdr: DataFrame, sdr: DataFrame, key: str = "relative") -> DataFrame:
    """Names that one side lacks, with the side that lacks them."""
    no_sdr = hdr.select(key).join(sdr.select(key), key, "left_anti")
    no_hdr = sdr.select(key).join(hdr.select(key), key, "left_anti")
    return no_sdr.withColumn("missing", F.lit("sdr")).unionByName(
        no_hdr.withColumn("missing", F.lit("hdr"))
    )


def expert_match(files: DataFrame, experts: DataFrame) -> DataFrame:
    """Attach ``expert``: the expert file at the same relative path, else at the root by name.

    ``files`` has ``relative``; ``experts`` has ``relative`` (of the expert folder) and
    ``expert`` (its path).
    """
    exact = experts.select("relative", F.col("expert").alias("_exact"))
    by_name = experts.select(F.col("relative").alias("_name"), F.col("expert").alias("_named"))
    named = files.withColumn("_name", labels.base_name(F.col("relative")))
    joined = named.join(exact, "relative", "left").join(by_name, "_name", "left")
    expert = F.coalesce("_exact", "_named").alias("expert")
    return joined.select(*files.columns, expert)


def offset_pairs(
    frames: DataFrame, experts: DataFrame, offset: int, payload: str = "expert"
) -> DataFrame:
    """Reference frame ``n + offset`` meets expert frame ``n`` of the same video.

    Expert slots whose ``payload`` is null hold their place but make no pair.
    """
    if offset < 0:
        raise ValueError("frame offset must not be negative")
    moved = experts.where(F.col(payload).isNotNull()).withColumn(
        "frame", (F.col("frame") + offset).cast(frames.schema["frame"].dataType)
    )
    return frames.join(moved, ["video", "frame"])


def grid_entries(tmos: Sequence[str] | None = None, crfs: Sequence[int] = CRF_LEVELS) -> Column:
    """The degradation grid as an array of structs (tmo, crf), to be spread per frame."""
    names = sorted(TONE_OPERATORS) if tmos is None else list(tmos)
    return F.array(
        *(
            F.struct(F.lit(name).alias("tmo"), F.lit(int(crf)).alias("crf"))
            for name in names
            for crf in crfs
        )
    )


def degrade_grid(frames: DataFrame, tmos=None, crfs: Sequence[int] = CRF_LEVELS) -> DataFrame:
    """Every frame once per (operator, rate factor), with its storage keys."""
    spread = frames.select("*", F.inline(grid_entries(tmos, crfs)))
    return with_keys(spread)


def with_keys(records: DataFrame) -> DataFrame:
    video, frame = F.col("video"), F.col("frame")
    return records.withColumns(
        {
            "hdr_key": labels.hdr_key(video, frame),
            "sdr_key": labels.sdr_key(video, frame, F.col("tmo"), F.col("crf")),
        }
    )


def pair_records(
    derived: DataFrame,
    expert: DataFrame | None = None,
    native: DataFrame | None = None,
    tmos=None,
    crfs: Sequence[int] = CRF_LEVELS,
) -> DataFrame:
    """One record set from derived frames, expert pairs and native pairs.

    Each input has ``video``, ``frame``, ``split`` and ``source_dataset``.
    """
    base = ("video", "frame", "split", "source_dataset")
    parts = [degrade_grid(derived.select(*base), tmos, crfs)]
    for frames, label in ((expert, "expert"), (native, "native")):
        if frames is not None:
            plain = frames.select(
                *base, F.lit(label).alias("tmo"), F.lit(None).cast("int").alias("crf")
            )
            parts.append(with_keys(plain))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


def crf_order() -> Column:
    return F.coalesce(F.col("crf"), F.lit(-1))


def sorted_manifest(records: DataFrame) -> DataFrame:
    """Manifest order: a range-partitioned sort, files in order."""
    return records.orderBy("source_dataset", "video", "frame", "tmo", crf_order())


def manifest_ordinals(records: DataFrame, out: str = "ordinal") -> DataFrame:
    """The place of every record in manifest order.

    Videos are hex digests, so their leading digits spread evenly; frames of one video are
    cut further by the frame number.
    """
    coarse = F.concat_ws(" ", "source_dataset", F.substring("video", 1, 2))
    fine = F.struct(F.col("video"), F.floor(F.col("frame") / 4096).alias("block"))
    order = ["source_dataset", "video", "frame", "tmo", crf_order()]
    return number_rows(records, order, buckets=[coarse, fine], out=out)


def header_mismatch(
    actual: DataFrame, expected: DataFrame, fields: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """Fields on which headers differ; null equals null and a missing header is all null.

    With ``keys`` there is one header per key, without there is one row on each side.
    """

    def long(df: DataFrame, name: str) -> DataFrame:
        pairs = F.array(
            *(
                F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(name))
                for f in fields
            )
        )
        return df.select(*keys, F.inline(pairs))

    joined = long(expected, "expected").join(long(actual, "actual"), [*keys, "field"], "left")
    return joined.where(~F.col("actual").eqNullSafe(F.col("expected")))


def flatten_variants(records: DataFrame) -> DataFrame:
    """Picture records with a map of variants to one row per variant."""
    return records.select(
        "id",
        F.coalesce("category", F.lit("pgc")).alias("category"),
        F.col("hdr").alias("hdr_path"),
        F.explode("sdr_variants").alias("variant", "sdr_path"),
    )


def shape_mismatch(pairs: DataFrame) -> DataFrame:
    """Pairs whose two sides differ in height or width."""
    same = (F.col("sdr_height") == F.col("hdr_height")) & (F.col("sdr_width") == F.col("hdr_width"))
    return pairs.where(~same)


def must_match(pairs: DataFrame) -> DataFrame:
    """The same rows; reading one whose shapes differ is an error."""
    same = (F.col("sdr_height") == F.col("hdr_height")) & (F.col("sdr_width") == F.col("hdr_width"))
    message = F.concat(F.lit("shapes of a pair differ: "), F.col("sdr_key"))
    return pairs.where(F.when(same, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))
