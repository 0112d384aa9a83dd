"""Per-frame quality of paired PQ pixels, as sums over pixels.

A pixel table has prediction codes ``pr pg pb`` and target codes ``tr tg tb``. Every metric
here is a mean over pixels, so each task reduces its own pixels before anything is sent.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import RGB, at_least, lay, num, rgb
from ..functions.spaces import (
    PU21_PEAK,
    ictcp,
    itp_difference,
    luma_2020,
    pu21_encode,
)
from ..functions.transfer import MASTER_NITS, pq_eotf_nits

CORE_METRICS = ("psnr", "psnr_y", "ssim", "deitp")
OPTIONAL_METRICS = ("hdr_lpips", "hdr_vdp3", "fr_hidrovqa")
TEMPORAL_METRICS = ("flicker_raw", "flicker_reference", "flicker_excess")
CALIBRATED_METRICS = tuple(f"exposure_calibrated_{name}" for name in CORE_METRICS)
FRAME_METRICS = CALIBRATED_METRICS + CORE_METRICS + OPTIONAL_METRICS
ALL_METRICS = FRAME_METRICS + TEMPORAL_METRICS


def lay_light(pixels: DataFrame) -> tuple[DataFrame, RGB, RGB]:
    """Absolute light of both sides, decoded once per pixel."""
    pixels, predicted = lay(pixels, "_pn", rgb("p").map(pq_eotf_nits))
    pixels, target = lay(pixels, "_tn", rgb("t").map(pq_eotf_nits))
    return pixels, predicted, target


def _square(x: Column) -> Column:
    return x * x


def _mean_square(one: RGB, other: RGB) -> Column:
    parts = [_square(pu21_encode(a) - pu21_encode(b)) for a, b in zip(one, other)]
    return (parts[0] + parts[1] + parts[2]) / num(3)


def decibels(mean_square: Column) -> Column:
    """Peak signal to noise; identical sides end at the floor, not at infinity."""
    return num(10) * F.log10(num(PU21_PEAK**2) / at_least(mean_square, 1e-12))


def pixel_scores(
    pixels: DataFrame, keys: Sequence[str], metrics: Sequence[str] = ("psnr", "psnr_y", "deitp")
) -> DataFrame:
    """PSNR over channels, PSNR of luminance and colour difference, one row per key."""
    laid, predicted, target = lay_light(pixels)
    found = {}
    if "psnr" in metrics:
        found["psnr"] = decibels(F.avg(_mean_square(predicted, target)))
    if "psnr_y" in metrics:
        apart = pu21_encode(luma_2020(predicted)) - pu21_encode(luma_2020(target))
        found["psnr_y"] = decibels(F.avg(_square(apart)))
    if "deitp" in metrics:
        laid, one = lay(laid, "_pi", ictcp(predicted))
        laid, other = lay(laid, "_ti", ictcp(target))
        found["deitp"] = F.avg(itp_difference(one, other))
    return laid.groupBy(*keys).agg(*(found[name].alias(name) for name in metrics))


def colour_difference(pixels: DataFrame, out: str = "deitp") -> DataFrame:
    """Delta-E ITP of every pixel, not reduced."""
    laid, predicted, target = lay_light(pixels)
    laid, one = lay(laid, "_pi", ictcp(predicted))
    laid, other = lay(laid, "_ti", ictcp(target))
    return laid.select(*pixels.columns, itp_difference(one, other).alias(out))


def reconstruction_losses(
    pixels: DataFrame,
    keys: Sequence[str],
    weights: tuple[float, float] = (1.0, 0.5),
    peak: float = MASTER_NITS,
    also: Sequence[Column] = (),
) -> DataFrame:
    """Mean absolute luminance and channel error in light relative to the peak, and their sum.

    ``also`` are further aggregates of the same pixels, made in the same pass.
    """
    if peak <= 0:
        raise ValueError("peak must be positive")
    laid, predicted, target = lay_light(pixels)
    one, other = (c.map(lambda x: x / num(peak)) for c in (predicted, target))
    gaps = [F.abs(a - b) for a, b in zip(one, other)]
    means = laid.groupBy(*keys).agg(
        F.avg(F.abs(luma_2020(one) - luma_2020(other))).alias("luma_l1"),
        F.avg((gaps[0] + gaps[1] + gaps[2]) / num(3)).alias("rgb_l1"),
        *also,
    )
    total = num(weights[0]) * F.col("luma_l1") + num(weights[1]) * F.col("rgb_l1")
    return means.withColumn("recon_total", total)


def mean_square_error(one: Column, other: Column) -> Column:
    """An aggregate: the velocity loss of predicted and wanted values."""
    return F.avg(_square(one - other))


def feature_distance(one: Sequence[str], other: Sequence[str]) -> Column:
    """Distance between two feature vectors, each the unit vectors of its scales end to end."""

    def unit(name: str) -> Column:
        size = F.sqrt(F.aggregate(F.col(name), num(0), lambda acc, x: acc + x * x))
        return F.transform(F.col(name), lambda x: x / at_least(size, 1e-12))

    total = num(0)
    for a, b in zip(one, other):
        apart = F.zip_with(unit(a), unit(b), lambda x, y: (x - y) * (x - y))
        total = total + F.aggregate(apart, num(0), lambda acc, x: acc + x)
    return F.sqrt(total)
