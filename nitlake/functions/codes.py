"""Integer code values and the codec quality scale."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import clamp, num

SDR_CODES = 255
HDR_CODES = 65535

# The codec grid and the points of the quality scale.
CRF_LEVELS = (23, 31, 39)
QUALITY_POINTS = ((18, 90), (23, 75), (31, 45), (39, 20), (45, 12))
QUALITY_RANGE = (5, 95)


def quantise(signal: Column, codes: int) -> Column:
    """Signal in [0, 1] to integer codes; halves go to the even code."""
    return F.rint(clamp(signal, 0.0, 1.0) * num(codes)).cast("int")


def scale(code: Column, codes: int) -> Column:
    return code / num(codes)


def crf_quality(crf: Column) -> Column:
    """Still-image quality that stands for a rate factor: straight lines between points."""
    x = crf.cast("double")
    points = QUALITY_POINTS
    line = F.when(x <= num(points[0][0]), num(points[0][1]))
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        slope = (y1 - y0) / (x1 - x0)
        line = line.when(x <= num(x1), num(slope) * (x - num(x0)) + num(y0))
    line = line.otherwise(num(points[-1][1]))
    return F.floor(clamp(line, *QUALITY_RANGE)).cast("int")
