"""Tables and pictures that several test files use."""

import numpy as np

FOLDER = "/root/testdata/sf0.001"


def ramp(offset=0.0, side=16):
    base = np.linspace(0.02, 0.72, side * side).reshape(side, side)
    return np.stack([np.clip(base + shift + offset, 0, 1) for shift in (0, 0.02, 0.04)])
