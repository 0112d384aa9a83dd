"""Conversions between primaries: linear combinations of three channel columns."""

from __future__ import annotations

import numpy as np

from .common import RGB, clamp, num

# BT.2407 (four printed decimals), P3-D65 to BT.2020, BT.2020 to XYZ.
PRINTED_2020_TO_709 = [
    [1.6605, -0.5876, -0.0728],
    [-0.1246, 1.1329, -0.0083],
    [-0.0182, -0.1006, 1.1187],
]
P3_TO_2020 = np.array([
    [0.7530, 0.1986, 0.0484],
    [0.0457, 0.9418, 0.0125],
    [-0.0012, 0.0176, 0.9836],
])
XYZ_FROM_2020 = np.array([
    [0.6370, 0.1446, 0.1689],
    [0.2627, 0.6780, 0.0593],
    [0.0000, 0.0281, 1.0610],
])

# White must stay white, so the printed rows are scaled to sum to one.
TO_709 = np.array(PRINTED_2020_TO_709) / np.sum(PRINTED_2020_TO_709, axis=1, keepdims=True)
TO_2020 = np.linalg.inv(TO_709)
XYZ_TO_2020 = np.linalg.inv(XYZ_FROM_2020)


def crosstalk(alpha: float) -> np.ndarray:
    """Mixes ``alpha`` of each other channel into a channel."""
    if not 0.0 <= alpha < 1 / 3:
        raise ValueError("alpha must lie in [0, 1/3)")
    return np.full((3, 3), alpha) + (1 - 3 * alpha) * np.eye(3)


def mix(matrix, colour) -> RGB:
    """Apply a 3x3 matrix to a colour."""
    rows = []
    for row in np.asarray(matrix, dtype=float):
        terms = [num(weight) * channel for weight, channel in zip(row, colour)]
        rows.append(terms[0] + terms[1] + terms[2])
    return RGB(*rows)


def from_709(colour: RGB) -> RGB:
    return mix(TO_2020, colour)


def to_709(colour: RGB) -> RGB:
    return mix(TO_709, colour)


def from_p3(colour: RGB) -> RGB:
    return mix(P3_TO_2020, colour)


def to_709_clipped(colour: RGB) -> RGB:
    """The lossy step of the SDR chain: what BT.709 cannot hold is clipped."""
    return to_709(colour).map(lambda channel: clamp(channel, 0.0, 1.0))
