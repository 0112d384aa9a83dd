"""Exposure calibration of the expert track: one gain per content and variant."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import RGB, clamp, num, rgb
from ..functions.light import gained
from ..functions.spaces import pq_luminance_nits
from .attach import attach
from .quantile import quantiles

# The range of a gain.
LOWEST_GAIN, HIGHEST_GAIN = 0.25, 8.0


def _finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < num(float("inf")))


def fit_gains(
    pixels: DataFrame,
    keys: Sequence[str],
    low: float = LOWEST_GAIN,
    high: float = HIGHEST_GAIN,
) -> DataFrame:
    """Lower median of target over predicted luminance, held to [low, high].

    All valid pixels of all frames of a content count; a content without any has gain 1.
    """
    if not 0.0 < low <= high:
        raise ValueError("gain bounds must satisfy 0 < low <= high")
    keys = list(keys)
    lit = pixels.withColumns(
        {"_yp": pq_luminance_nits(rgb("p")), "_yt": pq_luminance_nits(rgb("t"))}
    )
    valid = _finite(F.col("_yp")) & _finite(F.col("_yt")) & (F.col("_yp") > num(1e-6))
    ratio = F.when(valid, F.col("_yt") / F.col("_yp"))
    ratios = lit.select(*keys, ratio.alias("_ratio"))
    medians = quantiles(ratios, keys, "_ratio", [0.5], ["_median"], discrete=True, empty=True)
    held = F.when(F.col("_median").isNull(), num(1.0))
    held = held.otherwise(clamp(F.col("_median"), low, high))
    return medians.select(*keys, held.alias("exposure_gain"))


def calibrate(pixels: DataFrame, gains: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The pixel table with every prediction multiplied by the gain of its content."""
    joined = attach(pixels, gains, keys)
    codes: RGB = gained(rgb("p"), F.col("exposure_gain"))
    return joined.withColumns({"p" + c: code for c, code in zip("rgb", codes)})
