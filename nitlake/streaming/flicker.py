"""Flicker of arriving frames: the batch result, reached frame by frame."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import in_order

STEP = "frame bigint, pred double, target double"


def flicker_steps(frames: DataFrame, late: str = "1 minute", quiet_ms: int | None = None) -> DataFrame:
    """A stream of per-tile changes; sums over tiles are those of the batch form.

    ``frames`` is a stream of ``video, variant, tile, ts, frame, pred, target``. Frames may come ``late``
    behind newer ones and in any order within that; a tile carries its last frame on. See :func:`in_order`.
    """

    def advance(key: tuple, before: tuple | None, rows: list[tuple]) -> tuple[dict[str, list], tuple]:
        last = None if before is None else [np.frombuffer(data) for data in before]
        made = []
        for frame, *planes in rows:
            now = [np.frombuffer(plane) for plane in planes]
            change = (None, None)
            if last is not None:
                if any(len(a) != len(b) for a, b in zip(now, last, strict=True)):
                    raise ValueError(f"frames of {key} differ in size")
                change = tuple(float(np.abs(a - b).sum()) for a, b in zip(now, last, strict=True))
            made.append((frame, *change))
            last = now
        return dict(zip(("frame", "pred", "target"), map(list, zip(*made, strict=True)), strict=True)), tuple(last)

    slim = frames.select("video", "variant", "tile", "ts", "frame", "pred", "target")
    keys = ["video", "variant", "tile"]
    return in_order(slim, keys, "ts", ["frame"], advance, STEP, late, quiet_ms)


def frame_steps(steps: DataFrame) -> DataFrame:
    """Tile changes that a sink has stored, summed to frames as the batch form has them."""
    return steps.groupBy("video", "variant", "frame").agg(
        F.sum("pred").alias("pred"), F.sum("target").alias("target")
    )
