"""Compression loss of still frames: block transform, quantisation and back.

It stands for the loss of a codec at a rate factor. Nothing is entropy coded; the tables
are the ones of the public still-image standard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import crf_quality

# Quantisation of luma and chroma at quality 50.
LUMA_TABLE = np.array([
    [16, 11, 10, 16, 24, 40, 51, 61],
    [12, 12, 14, 19, 26, 58, 60, 55],
    [14, 13, 16, 24, 40, 57, 69, 56],
    [14, 17, 22, 29, 51, 87, 80, 62],
    [18, 22, 37, 56, 68, 109, 103, 77],
    [24, 35, 55, 64, 81, 104, 113, 92],
    [49, 64, 78, 87, 103, 121, 120, 101],
    [72, 92, 95, 98, 112, 100, 103, 99],
])
CHROMA_TABLE = np.array([
    [17, 18, 24, 47, 99, 99, 99, 99],
    [18, 21, 26, 66, 99, 99, 99, 99],
    [24, 26, 56, 99, 99, 99, 99, 99],
    [47, 66, 99, 99, 99, 99, 99, 99],
    [99, 99, 99, 99, 99, 99, 99, 99],
    [99, 99, 99, 99, 99, 99, 99, 99],
    [99, 99, 99, 99, 99, 99, 99, 99],
    [99, 99, 99, 99, 99, 99, 99, 99],
])

_U, _X = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
BASIS = np.cos((2 * _X + 1) * _U * np.pi / 16) * np.where(_U == 0, np.sqrt(0.125), 0.5)


def table_at(table: np.ndarray, quality: int) -> np.ndarray:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((table * scale + 50) // 100, 1, 255)


def _whole(x: np.ndarray) -> np.ndarray:
    # Cosines are inexact; exact halves are restored first, so that ties fall alike anywhere.
    return np.rint(np.round(x, 9))


def plane_loss(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    """One plane of codes through 8x8 blocks; edges are repeated to fill the last block."""
    rows, columns = plane.shape
    wide = np.pad(plane, ((0, -rows % 8), (0, -columns % 8)), mode="edge") - 128.0
    blocks = wide.reshape(wide.shape[0] // 8, 8, -1, 8).transpose(0, 2, 1, 3)
    kept = _whole(BASIS @ blocks @ BASIS.T / table) * table
    back = (BASIS.T @ kept @ BASIS).transpose(0, 2, 1, 3).reshape(wide.shape)
    return np.clip(_whole(back + 128), 0, 255)[:rows, :columns]


def frame_loss(rgb: np.ndarray, quality: int) -> np.ndarray:
    """A (3, h, w) frame of 8-bit codes; chroma at half size both ways."""
    r, g, b = rgb.astype(float)
    y = 0.299 * r + 0.587 * g + 0.114 * b
    planes = [plane_loss(np.rint(y), table_at(LUMA_TABLE, quality))]
    rows, columns = y.shape
    for chroma in ((b - y) / 1.772 + 128, (r - y) / 1.402 + 128):
        even = np.pad(chroma, ((0, rows % 2), (0, columns % 2)), mode="edge")
        half = even.reshape(even.shape[0] // 2, 2, -1, 2).mean(axis=(1, 3))
        lost = plane_loss(np.rint(half), table_at(CHROMA_TABLE, quality))
        planes.append(lost.repeat(2, axis=0).repeat(2, axis=1)[:rows, :columns] - 128)
    y, cb, cr = planes
    r, b = y + 1.402 * cr, y + 1.772 * cb
    g = (y - 0.299 * r - 0.114 * b) / 0.587
    return np.clip(np.rint(np.stack([r, g, b])), 0, 255).astype(int)


def codec_loss(frames: DataFrame, crf: str = "crf") -> DataFrame:
    """Frames of integer planes ``r g b`` after the loss of the rate factor in ``crf``.

    A null rate factor means no codec. Each frame is worked on in its own row.
    """
    ready = frames.withColumn("_quality", crf_quality(F.col(crf)))
    schema = frames.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            planes = {c: [] for c in "rgb"}
            for row in batch.to_dict("records"):
                shape = (int(row["height"]), int(row["width"]))
                picture = np.stack([np.asarray(row[c]).reshape(shape) for c in "rgb"])
                if not pd.isna(row[crf]):
                    picture = frame_loss(picture, int(row["_quality"]))
                for c, plane in zip("rgb", picture):
                    planes[c].append(plane.ravel().astype("int32"))
            yield batch.drop(columns="_quality").assign(**planes)

    return ready.mapInPandas(run, schema)
