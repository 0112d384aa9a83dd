"""HDR to SDR tone mapping and the two analytic inverses, on whole DataFrames.

Each operator takes PQ codes and returns a BT.709 signal. An operator is a function
``(df, codes, nits, tag, peak) -> (df, signal)``, where ``nits`` are the decoded codes held
to the peak. It lays its intermediate steps into columns whose names begin with ``tag``, so
that luminance is computed once per pixel and not once per channel, and light is decoded
once for all operators of a grid. :func:`tone_map` removes these columns again.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import curves, gamut
from .common import RGB, at_least, at_most, clamp, lay, num, rgb
from .curves import SDR_NITS, check_peak
from .spaces import luma_2020, luma_709
from .transfer import (
    MASTER_NITS,
    bt1886_eotf,
    bt1886_inverse,
    pq_code_of,
    pq_eotf_nits,
    pq_oetf_nits,
)

Operator = Callable[[DataFrame, RGB, RGB, str, float], tuple[DataFrame, RGB]]

CROSSTALK = 0.10

# Rational filmic curve.
FILMIC = (2.51, 0.03, 2.43, 0.59, 0.14)
# Log curve, linear part below the cut.
LOG_CUT, LOG_SLOPE, LOG_OFFSET = 0.011, 5.37, 0.093
LOG_A, LOG_B, LOG_C, LOG_D = 5.555556, 0.052272, 0.247190, 0.385537


def _nits(df: DataFrame, codes: RGB, peak: float) -> tuple[DataFrame, RGB]:
    check_peak(peak)
    return lay(df, "_tm_n", codes.map(lambda c: at_most(pq_eotf_nits(c), peak)))


def _sdr_signal(df: DataFrame, light: RGB, tag: str) -> tuple[DataFrame, RGB]:
    """BT.2020 light, 1 = SDR white, to a clipped and encoded BT.709 signal."""
    df, light = lay(df, f"{tag}l", light)
    # The encoding clips what BT.709 cannot hold.
    return df, gamut.to_709(light).map(bt1886_inverse)


def _relight(colour: RGB, luminance: Column, wanted: Column) -> RGB:
    """Give a colour another luminance and keep its chromaticity; black stays black."""
    ratio = wanted / at_least(luminance, 1e-8)
    return colour.map(lambda c: F.when(luminance > num(0), c * ratio).otherwise(num(0)))


def _by_luminance(curve: Callable[[Column, float], Column]) -> Operator:
    def operator(df, codes, nits, tag, peak):
        df = df.withColumn(f"{tag}y", luma_2020(nits))
        y = F.col(f"{tag}y")
        df = df.withColumn(f"{tag}z", curve(y, peak))
        relit = _relight(nits, y, F.col(f"{tag}z"))
        return _sdr_signal(df, relit.map(lambda c: c / num(SDR_NITS)), tag)

    return operator


def _by_channel(curve: Callable[[Column, float], Column]) -> Operator:
    """A curve from nits to SDR light, applied to each channel on its own."""

    def operator(df, codes, nits, tag, peak):
        return _sdr_signal(df, nits.map(lambda c: curve(c, peak)), tag)

    return operator


def bt2446c(df, codes, nits, tag, peak, alpha: float = CROSSTALK):
    """Method C on the Y of XYZ, with crosstalk around it."""
    df, xyz = lay(df, f"{tag}x", gamut.mix(gamut.XYZ_FROM_2020 @ gamut.crosstalk(alpha), nits))
    df = df.withColumn(f"{tag}z", curves.method_c(xyz.g, peak))
    df, relit = lay(df, f"{tag}w", _relight(xyz, xyz.g, F.col(f"{tag}z")))
    back = np.linalg.inv(gamut.crosstalk(alpha)) @ gamut.XYZ_TO_2020
    return _sdr_signal(df, gamut.mix(back / SDR_NITS, relit), tag)


def bt2390(df, codes, nits, tag, peak):
    """Hermite roll-off in PQ code space, channel by channel."""
    source, target = pq_code_of(check_peak(peak)), pq_code_of(SDR_NITS)
    top = target / source
    knee = 1.5 * top - 0.5
    df, e = lay(df, f"{tag}e", codes.map(lambda c: clamp(c, 0.0, source) / num(source)))
    df, t = lay(df, f"{tag}t", e.map(lambda c: (c - num(knee)) / num(1 - knee + 1e-9)))
    rolled = []
    for code, x in zip(e, t):
        x2 = x * x
        x3 = x2 * x
        hermite = (
            (num(2) * x3 - num(3) * x2 + num(1)) * num(knee)
            + (x3 - num(2) * x2 + x) * num(1 - knee)
            + (num(3) * x2 - num(2) * x3) * num(top)
        )
        rolled.append(F.when(code < num(knee), code).otherwise(hermite))
    df, rolled = lay(df, f"{tag}h", RGB(*rolled))
    nits = rolled.map(lambda c: pq_eotf_nits(clamp(c * num(source), 0.0, target)))
    return _sdr_signal(df, nits.map(lambda c: c / num(SDR_NITS)), tag)


def _clip_curve(nits: Column, peak: float) -> Column:
    return nits / num(SDR_NITS)


def _filmic_curve(nits: Column, peak: float) -> Column:
    a, b, c, d, e = FILMIC
    x = nits / num(0.18 * peak / 4)
    return clamp((x * (num(a) * x + num(b))) / (x * (num(c) * x + num(d)) + num(e)), 0.0, 1.0)


def _log_curve(nits: Column, peak: float) -> Column:
    x = nits / num(SDR_NITS)
    upper = num(LOG_C) * F.log10(at_least(num(LOG_A) * x + num(LOG_B), 1e-6)) + num(LOG_D)
    linear = num(LOG_SLOPE) * x + num(LOG_OFFSET)
    return clamp(F.when(x < num(LOG_CUT), linear).otherwise(upper), 0.0, 1.0)


def gamma_curve(gamma: float = 1.4) -> Callable[[Column, float], Column]:
    if gamma <= 0:
        raise ValueError("gamma must be positive")
    return lambda nits, peak: F.pow(at_least(nits / num(peak), 0.0), num(1 / gamma))


# The registry is open: add a name to offer another operator.
TONE_OPERATORS: dict[str, Operator] = {
    "bt2390_eetf_gm": bt2390,
    "bt2446a": _by_luminance(curves.method_a),
    "bt2446c_gm": bt2446c,
    "gamma_clip": _by_channel(gamma_curve()),
    "hard_clip_gm": _by_channel(_clip_curve),
    "ocio_filmic": _by_channel(_filmic_curve),
    "reinhard": _by_luminance(curves.reinhard),
    "youtube_logc": _by_channel(_log_curve),
}


def operator_named(name: str) -> Operator:
    if name not in TONE_OPERATORS:
        raise KeyError(f"unknown tone operator {name!r}; known: {sorted(TONE_OPERATORS)}")
    return TONE_OPERATORS[name]


def tone_map(
    df: DataFrame, name: str, codes: str = "", out: str = "s", peak: float = MASTER_NITS
) -> DataFrame:
    """Add columns ``<out>r/g/b`` with the SDR signal of the PQ codes ``<codes>r/g/b``."""
    operator = operator_named(name)
    laid, nits = _nits(df, rgb(codes), peak)
    laid, signal = operator(laid, rgb(codes), nits, "_tm0_", peak)
    return laid.select(*df.columns, *(s.alias(out + c) for s, c in zip(signal, "rgb")))


def tone_wide(
    df: DataFrame, names: list[str], codes: str = "", peak: float = MASTER_NITS
) -> DataFrame:
    """The grid side by side: columns ``<name>_r``, ``<name>_g``, ``<name>_b``."""
    laid, nits = _nits(df, rgb(codes), peak)
    out = []
    for index, name in enumerate(names):
        laid, signal = operator_named(name)(laid, rgb(codes), nits, f"_tm{index}_", peak)
        laid, signal = lay(laid, f"_tm{index}_s", signal)
        out += [s.alias(f"{name}_{c}") for s, c in zip(signal, "rgb")]
    return laid.select(*df.columns, *out)


def tone_grid(
    df: DataFrame, names: list[str] | None = None, codes: str = "", peak: float = MASTER_NITS
) -> DataFrame:
    """One row per input row and operator: columns ``tmo``, ``sr``, ``sg``, ``sb``.

    Every operator is computed in the same pass over a row and the row is then spread out,
    so the grid needs neither a cross join nor a second scan.
    """
    names = sorted(TONE_OPERATORS) if names is None else list(names)
    laid, nits = _nits(df, rgb(codes), peak)
    entries = []
    for index, name in enumerate(names):
        laid, signal = operator_named(name)(laid, rgb(codes), nits, f"_tm{index}_", peak)
        laid, signal = lay(laid, f"_tm{index}_s", signal)
        entries.append(
            F.struct(
                F.lit(name).alias("tmo"),
                *(s.alias("s" + c) for s, c in zip(signal, "rgb")),
            )
        )
    return laid.select(*df.columns, F.inline(F.array(*entries)))


def _sdr_2020_nits(signal: RGB) -> RGB:
    return gamut.from_709(signal.map(lambda c: bt1886_eotf(c) * num(SDR_NITS)))


def invert_bt2446c(
    df: DataFrame,
    signal: str = "",
    out: str = "h",
    alpha: float = CROSSTALK,
    peak: float = MASTER_NITS,
) -> DataFrame:
    """Undo method C: BT.709 signal to PQ codes. A clipped gamut stays clipped."""
    check_peak(peak)
    tag = "_iv_"
    laid, nits = lay(df, f"{tag}n", _sdr_2020_nits(rgb(signal)))
    laid, xyz = lay(
        laid, f"{tag}x", gamut.mix(gamut.XYZ_FROM_2020 @ gamut.crosstalk(alpha), nits)
    )
    laid = laid.withColumn(f"{tag}z", curves.method_c_inverse(xyz.g, peak))
    laid, relit = lay(laid, f"{tag}w", _relight(xyz, xyz.g, F.col(f"{tag}z")))
    back = np.linalg.inv(gamut.crosstalk(alpha)) @ gamut.XYZ_TO_2020
    codes = gamut.mix(back, relit).map(lambda c: pq_oetf_nits(clamp(c, 0.0, peak)))
    return laid.select(*df.columns, *(s.alias(out + c) for s, c in zip(codes, "rgb")))


def invert_reinhard(
    df: DataFrame, signal: str = "", out: str = "h", peak: float = MASTER_NITS
) -> DataFrame:
    """Undo Reinhard on luminance: BT.709 signal to PQ codes."""
    check_peak(peak)
    tag = "_iv_"
    laid, nits = lay(df, f"{tag}n", _sdr_2020_nits(rgb(signal)))
    laid = laid.withColumn(f"{tag}y", luma_2020(nits))
    y = F.col(f"{tag}y")
    laid = laid.withColumn(f"{tag}z", curves.reinhard_inverse(y, peak))
    relit = _relight(nits, y, F.col(f"{tag}z"))
    codes = relit.map(lambda c: pq_oetf_nits(clamp(c, 0.0, peak)))
    return laid.select(*df.columns, *(s.alias(out + c) for s, c in zip(codes, "rgb")))


def sdr_preview(
    df: DataFrame,
    codes: str = "",
    out: str = "s",
    white: float = 203.0,
    peak: float = MASTER_NITS,
    method: str = "reinhard",
) -> DataFrame:
    """A look at PQ codes on an SDR screen, with ``white`` nits put at SDR white."""
    if method not in ("reinhard", "clip"):
        raise ValueError(f"unknown preview method {method!r}")
    tag = "_pv_"
    light = gamut.to_709(rgb(codes).map(pq_eotf_nits))
    laid, light = lay(df, f"{tag}l", light.map(lambda c: at_least(c, 0.0) / num(white)))
    if method == "reinhard":
        limit = max(peak / white, 1.0)
        laid = laid.withColumn(f"{tag}y", luma_709(light))
        y = F.col(f"{tag}y")
        squeezed = y * (num(1) + y / num(limit * limit)) / (num(1) + y)
        laid = laid.withColumn(f"{tag}k", squeezed / at_least(y, 1e-6))
        light = light.map(lambda c: c * F.col(f"{tag}k"))
    signal = light.map(bt1886_inverse)
    return laid.select(*df.columns, *(s.alias(out + c) for s, c in zip(signal, "rgb")))
