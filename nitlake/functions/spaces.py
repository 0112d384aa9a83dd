"""Luma, Y'CbCr, ICtCp, PU21 and the colour difference built on them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import RGB, at_least, clamp, num
from .gamut import mix
from .transfer import pq_eotf_nits, pq_oetf_nits

# Luma weights.
LUMA_2020 = (0.2627, 0.6780, 0.0593)
LUMA_709 = (0.2126, 0.7152, 0.0722)

# BT.2100 ICtCp, in 4096ths.
LMS_FROM_2020 = np.array([[1688, 2146, 262], [683, 2951, 462], [99, 309, 3688]]) / 4096
ICTCP_FROM_LMS = np.array([[2048, 2048, 0], [6610, -13613, 7003], [17933, -17390, -543]]) / 4096

# PU21, banding and glare.
PU21 = (
    0.353487901,
    0.3734658629,
    8.277049286e-05,
    0.9062562627,
    0.0915030316,
    0.9099517204,
    596.3148142,
)


def _pu21_of(nits: float) -> float:
    a, b, c, d, e, f, g = PU21
    power = nits**d
    return max(g * (((a + b * power) / (1 + c * power)) ** e - f), 0.0)


PU21_PEAK = _pu21_of(10_000.0)


def weighted(colour: RGB, weights) -> Column:
    return num(weights[0]) * colour.r + num(weights[1]) * colour.g + num(weights[2]) * colour.b


def luma_2020(colour: RGB) -> Column:
    return weighted(colour, LUMA_2020)


def luma_709(colour: RGB) -> Column:
    return weighted(colour, LUMA_709)


def pq_luminance_nits(codes: RGB) -> Column:
    return luma_2020(codes.map(pq_eotf_nits))


def to_ycbcr(colour: RGB) -> tuple[Column, Column, Column]:
    y = luma_2020(colour)
    return y, (colour.b - y) / num(1.8814), (colour.r - y) / num(1.4746)


def from_ycbcr(y: Column, cb: Column, cr: Column) -> RGB:
    r = y + num(1.4746) * cr
    b = y + num(1.8814) * cb
    return RGB(r, (y - num(LUMA_2020[0]) * r - num(LUMA_2020[2]) * b) / num(LUMA_2020[1]), b)


def ictcp(nits: RGB) -> RGB:
    """Linear BT.2020 in nits to (I, Ct, Cp)."""
    lms = mix(LMS_FROM_2020, nits.map(lambda channel: at_least(channel, 0.0)))
    return mix(ICTCP_FROM_LMS, lms.map(pq_oetf_nits))


def pq_ictcp(codes: RGB) -> RGB:
    return ictcp(codes.map(pq_eotf_nits))


def itp_difference(one: RGB, other: RGB) -> Column:
    """Delta-E ITP of two ICtCp colours."""
    i, t, p = (a - b for a, b in zip(one, other))
    half = num(0.5) * t
    return num(720) * F.sqrt(i * i + half * half + p * p + num(1e-20))


def pu21_encode(nits: Column) -> Column:
    a, b, c, d, e, f, g = PU21
    power = F.pow(clamp(nits, 0.005, 10_000.0), num(d))
    ratio = (num(a) + num(b) * power) / (num(1) + num(c) * power)
    return at_least(num(g) * (F.pow(ratio, num(e)) - num(f)), 0.0)


def pu21_decode(units: Column) -> Column:
    a, b, c, d, e, f, g = PU21
    ratio = F.pow(at_least(units, 0.0) / num(g) + num(f), num(1 / e))
    power = at_least((ratio - num(a)) / (num(b) - num(c) * ratio), 0.0)
    return clamp(F.pow(power, num(1 / d)), 0.005, 10_000.0)
