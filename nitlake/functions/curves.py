"""Scalar tone curves on luminance columns and their inverses."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import at_least, clamp, num
from .transfer import MASTER_NITS, PQ_NITS

SDR_NITS = 100.0

# BT.2446 method C curve.
K1 = 0.83802
K2 = 15.09968
K3 = 0.74204
K4 = 78.99439
KNEE_SDR = 58.5
KNEE_HDR = KNEE_SDR / K1

# BT.2446 method A, the three pieces of the tone curve.
A_LOW, A_HIGH = 0.7399, 0.9909
A_LINEAR = 1.0770
A_SQUARE = (-1.1510, 2.7811, -0.6302)


def check_peak(peak: float) -> float:
    if not 0.0 < peak <= PQ_NITS:
        raise ValueError("peak must lie in (0, 10000]")
    return float(peak)


def method_c_scale(peak: float = MASTER_NITS) -> float:
    """The constant that maps the mastering peak to SDR white."""
    peak = check_peak(peak)
    if peak < KNEE_HDR:
        return SDR_NITS / (K1 * peak)
    return SDR_NITS / (K2 * math.log(max(peak / KNEE_HDR - K3, 1e-12)) + K4)


def method_c(nits: Column, peak: float = MASTER_NITS) -> Column:
    """Method C luminance, HDR nits to SDR nits, anchored so that ``peak`` gives 100."""
    scale = method_c_scale(peak)
    y = clamp(nits, 0.0, peak)
    upper = num(K2) * F.log(at_least(y / num(KNEE_HDR) - num(K3), 1e-12)) + num(K4)
    return F.when(y < num(KNEE_HDR), num(K1) * y).otherwise(upper) * num(scale)


def method_c_inverse(sdr_nits: Column, peak: float = MASTER_NITS) -> Column:
    unscaled = at_least(sdr_nits, 0.0) / num(method_c_scale(peak))
    upper = num(KNEE_HDR) * (F.exp((unscaled - num(K4)) / num(K2)) + num(K3))
    nits = F.when(unscaled < num(KNEE_SDR), unscaled / num(K1)).otherwise(upper)
    return clamp(nits, 0.0, peak)


def reinhard(nits: Column, peak: float = MASTER_NITS) -> Column:
    """White-point Reinhard, HDR nits to SDR nits."""
    white = check_peak(peak) / SDR_NITS
    x = clamp(nits, 0.0, peak) / num(SDR_NITS)
    return num(SDR_NITS) * x * (num(1) + x / num(white * white)) / (num(1) + x)


def reinhard_inverse(sdr_nits: Column, peak: float = MASTER_NITS) -> Column:
    """The positive root of the quadratic that the forward curve leaves."""
    white = check_peak(peak) / SDR_NITS
    a = 1 / (white * white)
    out = clamp(sdr_nits, 0.0, SDR_NITS) / num(SDR_NITS)
    b = num(1) - out
    x = (F.sqrt(b * b + num(4 * a) * out) - b) / num(2 * a)
    return clamp(x * num(SDR_NITS), 0.0, peak)


def method_a(nits: Column, peak: float = MASTER_NITS) -> Column:
    """Method A luminance, HDR nits to SDR nits."""
    check_peak(peak)
    rho_in = 1 + 32 * (peak / PQ_NITS) ** (1 / 2.4)
    rho_out = 1 + 32 * (SDR_NITS / PQ_NITS) ** (1 / 2.4)
    gamma = F.pow(at_least(nits / num(peak), 1e-6), num(1 / 2.4))
    x = F.log1p(num(rho_in - 1) * gamma) / num(math.log(rho_in))
    square, slope, offset = A_SQUARE
    bent = (
        F.when(x <= num(A_LOW), num(A_LINEAR) * x)
        .when(x < num(A_HIGH), num(square) * x * x + num(slope) * x + num(offset))
        .otherwise(num(0.5) * x + num(0.5))
    )
    light = at_least((F.pow(num(rho_out), bent) - num(1)) / num(rho_out - 1), 0.0)
    return F.pow(light, num(2.4)) * num(SDR_NITS)
