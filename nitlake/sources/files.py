"""Folders as tables of paths, and reference lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels
from ..operators.numbering import number_rows
from ..operators.select import reference_list


def list_files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """Paths, sizes and relative names of the files below a folder; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    root = folder.rstrip("/")
    files = reader.load(root).select("path", "length")
    return files.withColumn("relative", F.regexp_replace("path", f"^.*?{_quoted(root)}/", ""))


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def kind_of(path: Column) -> Column:
    """``video``, ``image`` or null, by lower-cased suffix."""
    ending = labels.suffix(path)
    return F.when(ending.isin(*labels.VIDEO_SUFFIXES), "video").when(
        ending.isin(*labels.IMAGE_SUFFIXES), "image"
    )


def discover(files: DataFrame, source: Column, path: str = "relative") -> DataFrame:
    """Supported files with their kind and the stable name of the video they belong to.

    A video file is a video by itself; images belong to the video of their folder.
    """
    kind = kind_of(F.col(path))
    folder = F.when(F.col("parent") == "", F.lit(".")).otherwise(F.col("parent"))
    holder = F.when(F.col("kind") == "video", F.col(path)).otherwise(folder)
    found = files.withColumns({"kind": kind, "parent": labels.parent(F.col(path))})
    found = found.where(F.col("kind").isNotNull())
    return found.withColumn("video", labels.stable_hash(source, holder))


def sequences(images: DataFrame, path: str = "relative", parent: str = "parent") -> DataFrame:
    """Frame numbers of images: place by name within their folder."""
    return number_rows(images, [path], [parent], out="frame")


def reference_csv(
    spark: SparkSession,
    path: str,
    hash_column: str = "Video",
    filter_column: str | None = "ref",
    filter_value: str = "1",
) -> DataFrame:
    """Hashes of a CSV list; a filter column the file lacks matches nothing."""
    rows = spark.read.option("header", True).csv(path)
    if filter_column not in rows.columns:
        filter_column = None
    return reference_list(rows, hash_column, filter_column, filter_value)


def video_hashes(files: DataFrame, source: str) -> DataFrame:
    """All video names of a folder, before any holdout, in order.

    Where a folder has video files its images are not frames.
    """
    found = discover(files, F.lit(source))
    videos = found.where(F.col("kind") == "video").agg(F.count(F.lit(1))).scalar()
    used = found.where((F.col("kind") == "video") | (videos == 0))
    return used.select("video").distinct().orderBy("video")


def conversion_inputs(files: DataFrame, cap: int | None = None) -> DataFrame:
    """Images directly in a folder, by name; at most ``cap`` where one is given (not 0)."""
    images = files.where(~F.col("relative").contains("/"))
    images = images.where(kind_of(F.col("path")) == "image").orderBy("path")
    return images.limit(cap) if cap else images
