"""Monotone tone curves with parameters held in array columns.

A curve has ``K`` bins: ``widths`` and ``heights`` are ``K`` free numbers each, ``slopes``
are ``K + 1``. Softmax turns the first two into bin sizes, softplus the last into knot
derivatives, so any numbers give a rising curve from (0, 0) to (1, 1).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import RGB, at_least, clamp, lay, num, rgb
from .spaces import from_ycbcr, to_ycbcr
from .transfer import MASTER_NITS, pq_code_of

# The smallest bin and the smallest derivative.
SMALLEST_BIN = 1e-3
SMALLEST_SLOPE = 1e-3
# The free number that gives derivative one, hence the straight line.
STRAIGHT = math.log(math.expm1(1 - SMALLEST_SLOPE))


def _total(values: Column) -> Column:
    return F.aggregate(values, num(0), lambda acc, x: acc + x)


def bin_sizes(free: Column, bins: int) -> Column:
    """Softmax with a floor under every bin."""
    peak = F.array_max(free)
    grown = F.transform(free, lambda x: F.exp(x - peak))
    total = _total(grown)
    return F.transform(
        grown, lambda x: num(SMALLEST_BIN) + num(1 - SMALLEST_BIN * bins) * x / total
    )


def knot_slopes(free: Column) -> Column:
    # softplus, written so that a large argument does not overflow
    return F.transform(
        free,
        lambda x: num(SMALLEST_SLOPE) + at_least(x, 0.0) + F.log1p(F.exp(-F.abs(x))),
    )


def knots(sizes: Column, bins: int) -> Column:
    """Running total of bin sizes, from exactly 0 to exactly 1."""
    running = F.aggregate(
        F.slice(sizes, 1, bins - 1),
        F.array(num(0)),
        lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)),
    )
    return F.concat(running, F.array(num(1)))


def lay_curve(
    df: DataFrame,
    widths: Column,
    heights: Column,
    slopes: Column | None,
    bins: int,
    tag: str = "_c_",
) -> DataFrame:
    """Lay out a curve once per parameter row, before rows are spread to pixels."""
    df = df.withColumns({f"{tag}w": bin_sizes(widths, bins), f"{tag}h": bin_sizes(heights, bins)})
    laid = {
        f"{tag}x": knots(F.col(f"{tag}w"), bins),
        f"{tag}y": knots(F.col(f"{tag}h"), bins),
    }
    if slopes is not None:
        laid[f"{tag}d"] = knot_slopes(slopes)
    return df.withColumns(laid)


def apply_curve(
    df: DataFrame, value: Column, out: str, bins: int, tag: str = "_c_", linear: bool = False
) -> DataFrame:
    """Add ``out``: the laid-out curve at ``value``."""
    at = lambda name, index: F.get(F.col(tag + name), index)
    inner = F.slice(F.col(f"{tag}x"), 2, bins - 1)
    df = df.withColumn("_v", clamp(value, 0.0, 1.0))
    v = F.col("_v")
    df = df.withColumn("_k", F.size(F.filter(inner, lambda knot: knot < v)))
    k = F.col("_k")
    df = df.withColumns({"_cw": at("w", k), "_ch": at("h", k), "_cy": at("y", k)})
    df = df.withColumn("_th", clamp((v - at("x", k)) / F.col("_cw"), 0.0, 1.0))
    th, cw, ch = F.col("_th"), F.col("_cw"), F.col("_ch")
    if linear:
        result = F.col("_cy") + th * ch
        spent = ["_v", "_k", "_cw", "_ch", "_cy", "_th"]
    else:
        df = df.withColumns({"_dl": at("d", k), "_dr": at("d", k + 1), "_sl": ch / cw})
        slope, both = F.col("_sl"), th * (num(1) - th)
        top = ch * (slope * th * th + F.col("_dl") * both)
        bottom = slope + (F.col("_dl") + F.col("_dr") - num(2) * slope) * both
        result = F.col("_cy") + top / at_least(bottom, 1e-8)
        spent = ["_v", "_k", "_cw", "_ch", "_cy", "_th", "_dl", "_dr", "_sl"]
    return df.withColumn(out, clamp(result, 0.0, 1.0)).drop(*spent)


def roughness(widths: Column, heights: Column, slopes: Column, bins: int) -> Column:
    """Mean squared change of bin slope plus mean squared change of knot derivative."""
    steep = F.zip_with(bin_sizes(heights, bins), bin_sizes(widths, bins), lambda h, w: h / w)

    def mean_change(values: Column, count: int) -> Column:
        steps = F.zip_with(
            F.slice(values, 2, count - 1), F.slice(values, 1, count - 1), lambda a, b: a - b
        )
        squares = F.aggregate(steps, num(0), lambda acc, x: acc + x * x)
        return squares / num(count - 1)

    return mean_change(steep, bins) + mean_change(knot_slopes(slopes), bins + 1)


def tone_field(
    df: DataFrame,
    codes: str = "",
    out: str = "o",
    bins: int = 8,
    tag: str = "_c_",
    strength: float = 1.0,
    chroma: tuple[tuple[float, float], tuple[float, float]] = ((1.0, 0.0), (0.0, 1.0)),
    bias: tuple[float, float] = (0.0, 0.0),
    peak: float = MASTER_NITS,
    linear: bool = False,
) -> DataFrame:
    """Bend the luma of PQ codes by the laid-out curve of the same row.

    Chroma goes through a 2x2 matrix plus bias. Codes are held to the mastering peak
    before and after.
    """
    top = pq_code_of(peak)
    laid, held = lay(df, "_tfc", rgb(codes).map(lambda c: clamp(c, 0.0, top)))
    y, cb, cr = to_ycbcr(held)
    laid = laid.withColumns({"_tfy": y, "_tfu": cb, "_tfv": cr})
    y, u, v = F.col("_tfy"), F.col("_tfu"), F.col("_tfv")
    laid = apply_curve(laid, y / num(top), "_tfz", bins, tag, linear)
    bent = F.col("_tfz") * num(top)
    if strength != 1.0:
        bent = y + num(strength) * (bent - y)
    laid = laid.withColumns(
        {
            "_tfn": bent,
            "_tfp": num(chroma[0][0]) * u + num(chroma[0][1]) * v + num(bias[0]),
            "_tfq": num(chroma[1][0]) * u + num(chroma[1][1]) * v + num(bias[1]),
        }
    )
    colour = from_ycbcr(F.col("_tfn"), F.col("_tfp"), F.col("_tfq"))
    held = RGB(*colour).map(lambda c: clamp(c, 0.0, top))
    return laid.select(*df.columns, *(s.alias(out + c) for s, c in zip(held, "rgb")))
