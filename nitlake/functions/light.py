"""Linear light, source normalisation and nit conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import gamut
from .common import RGB, at_least, clamp, num
from .transfer import (
    MASTER_NITS,
    PQ_NITS,
    bt1886_eotf,
    hlg_inverse,
    pq_eotf_nits,
    pq_oetf_nits,
)

SOURCE_FORMATS = ("pq2020", "hlg2020", "pq_p3d65", "sdr709")


def sdr_light(signal: RGB) -> RGB:
    """BT.709 signal to BT.2020 light in [0, 1]."""
    return gamut.from_709(signal.map(bt1886_eotf)).map(lambda c: clamp(c, 0.0, 1.0))


def pq_light(codes: RGB, peak: float = MASTER_NITS) -> RGB:
    """PQ code to light, where 1 is ``peak`` nits."""
    if peak <= 0:
        raise ValueError("peak must be positive")
    return codes.map(lambda c: pq_eotf_nits(c) / num(peak))


def saturation(light: RGB) -> Column:
    top = F.greatest(*light)
    return (top - F.least(*light)) / (top + num(1e-6))


def source_nits(signal: RGB, source_format: str, hlg_gamma: float = 1.2) -> RGB:
    """Absolute BT.2020 light of a signal in one of :data:`SOURCE_FORMATS`."""
    if source_format == "pq2020":
        return signal.map(pq_eotf_nits)
    if source_format == "pq_p3d65":
        return gamut.from_p3(signal.map(pq_eotf_nits)).map(lambda c: at_least(c, 0.0))
    if source_format == "hlg2020":
        # The system gamma is applied to each channel, not to luminance.
        return signal.map(
            lambda c: F.pow(at_least(hlg_inverse(c), 0.0), num(hlg_gamma)) * num(1000)
        )
    if source_format == "sdr709":
        light = gamut.from_709(signal.map(bt1886_eotf))
        return light.map(lambda c: at_least(c, 0.0) * num(100))
    raise ValueError(f"unknown source format {source_format!r}, expected one of {SOURCE_FORMATS}")


def normalise(signal: RGB, source_format: str, peak: float = MASTER_NITS) -> RGB:
    """Signal of a known format to PQ codes mastered at ``peak`` nits."""
    ceiling = min(peak, PQ_NITS)
    return source_nits(signal, source_format).map(
        lambda c: pq_oetf_nits(clamp(c, 0.0, ceiling))
    )


def normalise_by(signal: RGB, format_column: Column, peak: float = MASTER_NITS) -> RGB:
    """As :func:`normalise`, with the format read from each row."""
    forms = {name: normalise(signal, name, peak) for name in SOURCE_FORMATS}
    known = F.raise_error(F.concat(F.lit("unknown source format "), format_column)).cast("double")
    channels = []
    for index in range(3):
        choice = known
        for name in reversed(SOURCE_FORMATS):
            choice = F.when(format_column == name, forms[name][index]).otherwise(choice)
        channels.append(choice)
    return RGB(*channels)


def gained(codes: RGB, gain: Column) -> RGB:
    """PQ codes after multiplying absolute light by ``gain``; a gain of 1 keeps the codes."""
    return codes.map(
        lambda c: F.when(gain == num(1), c).otherwise(pq_oetf_nits(pq_eotf_nits(c) * gain))
    )


def nits709_to_pq(nits: RGB, peak: float = MASTER_NITS) -> RGB:
    """Absolute BT.709 light to PQ codes, held to ``peak`` before and after the matrix."""
    if peak <= 0:
        raise ValueError("peak must be positive")
    held = nits.map(lambda c: clamp(c, 0.0, peak))
    return gamut.from_709(held).map(lambda c: pq_oetf_nits(clamp(c, 0.0, peak)))
