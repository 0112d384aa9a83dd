"""Steady tone curves along a sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import spline
from ..operators.attach import attach
from ..operators.scan import smooth

SEQUENCE_ALPHA = 0.8


def stabilise(
    params: DataFrame, bins: int, alpha: float = SEQUENCE_ALPHA, number: str = "frame"
) -> DataFrame:
    """Smooth ``widths``, ``heights``, ``slopes`` along every ``video``.

    ``number`` counts frames 0, 1, 2, ... within a video. A single picture is not changed.
    """
    sizes = {"widths": bins, "heights": bins, "slopes": bins + 1}
    cells = {f"_{n}{i}": F.get(F.col(n), F.lit(i)) for n, k in sizes.items() for i in range(k)}
    flat = smooth(params.withColumns(cells), ["video"], number, list(cells), alpha)
    packed = {
        n: F.array(*(F.col(f"_{n}{i}") for i in range(k))) for n, k in sizes.items()
    }
    return flat.withColumns(packed).drop(*cells)


def apply_to_pixels(
    pixels: DataFrame, params: DataFrame, bins: int, strength: float = 1.0, **options
) -> DataFrame:
    """Bend PQ pixels ``r g b`` by the curve of their video and frame, as ``or og ob``."""
    curve = spline.lay_curve(
        params, F.col("widths"), F.col("heights"), F.col("slopes"), bins
    ).select("video", "frame", *(f"_c_{n}" for n in "whxyd"))
    joined = attach(pixels, curve, ["video", "frame"])
    bent = spline.tone_field(joined, out="o", bins=bins, strength=strength, **options)
    return bent.drop(*(f"_c_{n}" for n in "whxyd"))
