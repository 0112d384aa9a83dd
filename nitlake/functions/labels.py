"""Identifiers, labels and tags: string columns of manifests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File suffixes.
VIDEO_SUFFIXES = (".mp4", ".mov", ".mkv", ".webm", ".y4m")
IMAGE_SUFFIXES = (".png", ".tif", ".tiff", ".exr")

# Colour tags of containers.
UNKNOWN_TAGS = ("", "unknown", "unspecified", "reserved")
MATRIX_NAMES = {"bt470bg": "bt601", "smpte170m": "bt601", "bt2020nc": "bt2020"}
RANGE_NAMES = {"tv": "limited", "mpeg": "limited", "pc": "full", "jpeg": "full"}


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Lower-cased suffix with its dot; empty if there is none or only a leading dot."""
    return F.lower(F.regexp_extract(base_name(path), r"[^.].*?(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    name = base_name(path)
    cut = F.length(name) - F.length(suffix(path))
    return F.substring(name, F.lit(1), cut)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def stable_hash(source: Column, relative: Column) -> Column:
    """A stem that already is a long hex name is kept; anything else is hashed."""
    name = F.lower(stem(relative))
    digest = F.substring(F.sha2(F.concat_ws(":", source, relative), 256), 1, 32)
    return F.when(name.rlike("^[0-9a-f]{16,}$"), name).otherwise(digest)


def hdr_key(video: Column, frame: Column) -> Column:
    return F.concat_ws("/", F.lit("hdr"), video, frame.cast("string"))


def sdr_key(video: Column, frame: Column, tmo: Column, crf: Column) -> Column:
    level = F.coalesce(crf.cast("string"), F.lit("none"))
    return F.concat_ws("/", F.lit("sdr"), video, frame.cast("string"), tmo, level)


def variant_label(tmo: Column, crf: Column) -> Column:
    return F.when(crf.isNull(), tmo).otherwise(F.concat(tmo, F.lit("_crf"), crf.cast("string")))


def is_expert(track: Column, tmo: Column, variant: Column) -> Column:
    """First of track, tmo and variant that is there, compared without case."""
    return F.lower(F.coalesce(track, tmo, variant)) == "expert"


def content_id(content: Column, video_id: Column, video: Column, sequence: Column, row_id: Column):
    return F.coalesce(content, video_id, video, sequence, row_id, F.lit("unknown"))


def video_id(video_id: Column, video: Column, sequence: Column, row_id: Column, required: bool):
    """The video of a record; where one is required, a record without any is an error."""
    if required:
        last = F.raise_error(F.lit("a record has none of video_id, video, sequence_id"))
        return F.coalesce(video_id, video, sequence, last.cast("string"))
    return F.coalesce(video_id, video, sequence, row_id)


def safe_variant(variant: Column) -> Column:
    """A variant as part of a file name."""
    clean = F.regexp_replace(variant, "[^A-Za-z0-9_.-]+", "_")
    clean = F.regexp_replace(clean, "^[._]+|[._]+$", "")
    return F.when(clean == "", F.lit("variant")).otherwise(clean)


def padded(number: Column, width: int) -> Column:
    """Zero-padded to ``width``; longer numbers are kept whole."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))


def _tag(tag: Column, default: str, names: dict[str, str]) -> Column:
    known = F.lower(F.coalesce(tag, F.lit("")))
    resolved = F.when(known.isin(*UNKNOWN_TAGS), F.lit(default))
    for alias, name in names.items():
        resolved = resolved.when(known == alias, F.lit(name))
    return resolved.otherwise(known)


def colour_matrix(tag: Column, default: str) -> Column:
    return _tag(tag, default, MATRIX_NAMES)


def colour_range(tag: Column) -> Column:
    return _tag(tag, "limited", RANGE_NAMES)
