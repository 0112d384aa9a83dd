"""Frame statistics: code values, luminance, nit anchors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import light
from ..functions.common import at_least, clamp, lay, num, rgb
from ..functions.spaces import luma_709
from ..functions.transfer import MASTER_NITS
from .attach import attach
from .quantile import quantiles


def channel_values(pixels: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    """The three channels of every pixel under one column ``value``."""
    return pixels.select(*keys, F.explode(F.array(*rgb(prefix))).alias("value"))


def code_statistics(pixels: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    """Mean, 99th percentile and maximum of PQ codes over all channels."""
    values = channel_values(pixels, keys, prefix)
    basic = values.groupBy(*keys).agg(
        F.avg("value").alias("mean_pq_code"), F.max("value").alias("max_pq_code")
    )
    return basic.join(quantiles(values, keys, "value", [0.99], ["p99_pq_code"]), list(keys))


def global_stats(values: DataFrame, keys: Sequence[str], luminance: str) -> DataFrame:
    """Mean, unbiased deviation, 95th and 99th percentile of luminance."""
    basic = values.groupBy(*keys).agg(
        F.avg(luminance).alias("mean_y"), F.stddev_samp(luminance).alias("std_y")
    )
    tops = quantiles(values, keys, luminance, [0.95, 0.99], ["p95_y", "p99_y"])
    return basic.join(tops, list(keys))


def match_maximum(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Prediction codes scaled to the reference maximum of their frame (diagnosis only)."""
    tops = pixels.groupBy(*keys).agg(
        F.max(F.greatest(*rgb("p"))).alias("_pm"), F.max(F.greatest(*rgb("t"))).alias("_tm")
    )
    factors = tops.select(
        *keys, (F.col("_tm") / at_least(F.col("_pm"), 1e-8)).alias("factor")
    )
    scaled = rgb("p").map(lambda c: clamp(c * F.col("factor"), 0.0, 1.0))
    joined = attach(pixels, factors, keys)
    return joined.withColumns({"p" + c: code for c, code in zip("rgb", scaled)})


def anchor_scales(
    pixels: DataFrame,
    keys: Sequence[str],
    prefix: str,
    percentile: float = 99.5,
    target_nits: float = MASTER_NITS,
) -> DataFrame:
    """Per frame, the factor that puts a luminance percentile at ``target_nits``."""
    if not 0.0 < percentile <= 100.0:
        raise ValueError("percentile must lie in (0, 100]")
    if target_nits <= 0:
        raise ValueError("target_nits must be positive")
    y = luma_709(rgb(prefix).map(lambda c: at_least(c, 0.0)))
    lit = pixels.select(*keys, y.alias("_y"))
    anchors = quantiles(lit, keys, "_y", [percentile / 100], ["_anchor"])
    usable = (F.col("_anchor") > num(0)) & (F.col("_anchor") < num(float("inf")))
    scale = F.when(usable, num(target_nits) / F.col("_anchor")).otherwise(num(1))
    return anchors.select(*keys, scale.alias("anchor_scale"))


def anchored_pq(
    pixels: DataFrame,
    keys: Sequence[str],
    prefix: str,
    out: str = "h",
    percentile: float = 99.5,
    target_nits: float = MASTER_NITS,
) -> DataFrame:
    """Relative BT.709 light to PQ codes anchored frame by frame."""
    scales = anchor_scales(pixels, keys, prefix, percentile, target_nits)
    joined = attach(pixels, scales, keys)
    nits = rgb(prefix).map(
        lambda c: clamp(at_least(c, 0.0) * F.col("anchor_scale"), 0.0, target_nits)
    )
    laid, nits = lay(joined, "_an", nits)
    codes = light.nits709_to_pq(nits, target_nits)
    return laid.select(
        *joined.columns, *(code.alias(out + c) for code, c in zip(codes, "rgb"))
    )
