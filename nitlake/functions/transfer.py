"""Transfer functions: PQ, BT.709, BT.1886 and HLG, element by element.

PQ is absolute: code 1.0 stands for 10,000 cd/m2.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import at_least, clamp, num

# SMPTE ST 2084.
M1 = 2610 / 16384
M2 = 2523 / 4096 * 128
C1 = 3424 / 4096
C2 = 2413 / 4096 * 32
C3 = 2392 / 4096 * 32
PQ_NITS = 10_000.0
MASTER_NITS = 1_000.0

# BT.2100 hybrid log-gamma.
HLG_A, HLG_B, HLG_C = 0.17883277, 0.28466892, 0.55991073

DISPLAY_GAMMA = 2.4


def pq_code_of(nits: float) -> float:
    """PQ code of one luminance, for constants that are folded into a plan."""
    power = math.pow(min(max(nits / PQ_NITS, 1e-10), 1.0), M1)
    return math.pow((C1 + C2 * power) / (1 + C3 * power), M2)


MASTER_CODE = pq_code_of(MASTER_NITS)


def pq_oetf(light: Column) -> Column:
    """Light as a fraction of 10,000 nits to PQ code."""
    power = F.pow(clamp(light, 1e-10, 1.0), num(M1))
    return F.pow((num(C1) + num(C2) * power) / (num(1) + num(C3) * power), num(M2))


def pq_eotf(code: Column) -> Column:
    """PQ code to light as a fraction of 10,000 nits."""
    root = F.pow(clamp(code, 1e-8, 1.0), num(1 / M2))
    return F.pow(at_least(root - num(C1), 0.0) / (num(C2) - num(C3) * root), num(1 / M1))


def pq_eotf_nits(code: Column) -> Column:
    return pq_eotf(code) * num(PQ_NITS)


def pq_oetf_nits(nits: Column) -> Column:
    return pq_oetf(nits / num(PQ_NITS))


def bt709_oetf(light: Column) -> Column:
    x = clamp(light, 0.0, 1.0)
    curve = num(1.099) * F.pow(at_least(x, 1e-12), num(0.45)) - num(0.099)
    return F.when(x < num(0.018), num(4.5) * x).otherwise(curve)


def bt709_eotf(signal: Column) -> Column:
    x = clamp(signal, 0.0, 1.0)
    curve = F.pow(at_least((x + num(0.099)) / num(1.099), 1e-12), num(1 / 0.45))
    return F.when(x < num(0.018 * 4.5), x / num(4.5)).otherwise(curve)


def bt1886_eotf(signal: Column, gamma: float = DISPLAY_GAMMA) -> Column:
    return F.pow(clamp(signal, 0.0, 1.0), num(gamma))


def bt1886_inverse(light: Column, gamma: float = DISPLAY_GAMMA) -> Column:
    return F.pow(clamp(light, 0.0, 1.0), num(1 / gamma))


def hlg_oetf(light: Column) -> Column:
    x = clamp(light, 0.0, 1.0)
    upper = num(HLG_A) * F.log(at_least(num(12) * x - num(HLG_B), 1e-12)) + num(HLG_C)
    return F.when(x <= num(1 / 12), F.sqrt(num(3) * x)).otherwise(upper)


def hlg_inverse(signal: Column) -> Column:
    x = clamp(signal, 0.0, 1.0)
    upper = (F.exp((x - num(HLG_C)) / num(HLG_A)) + num(HLG_B)) / num(12)
    return F.when(x <= num(0.5), x * x / num(3)).otherwise(upper)
