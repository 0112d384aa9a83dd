"""Temporal consistency: change of PU21 luminance from frame to frame."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SINGLE = "skipped (single frame)"
#: Pixels of a plane that travel together. A long video spreads over its tiles.
TILE = 16_384


def tiles(frames: DataFrame, sides: Sequence[str] = ("pred", "target"), size: int = TILE) -> DataFrame:
    """Frames with planes ``sides`` cut into pieces of at most ``size`` pixels, numbered ``tile``."""
    count = F.ceil(F.size(sides[0]) / F.lit(size)).cast("int")
    spread = frames.select("*", F.explode(F.sequence(F.lit(0), count - 1)).alias("tile"))
    return spread.withColumns({name: F.slice(name, F.col("tile") * size + 1, size) for name in sides})


def tile_transitions(
    frames: DataFrame, keys: Sequence[str], frame: str, size: int = TILE, sides: Sequence[str] = ("pred", "target")
) -> DataFrame:
    """As :func:`transitions`, from whole planes of PU21 luminance in the columns named by ``sides``.

    A tile of a frame is one row of numbers: it is that rows which are shuffled and sorted, and a
    tile meets the one before it in the same row. Planes of one key must have one size.
    """
    keys, sides = list(keys), list(sides)
    along = Window.partitionBy(*keys, "tile").orderBy(frame)
    cut = tiles(frames.select(*keys, frame, *sides), sides, size)
    met = cut.withColumns({f"{side}_before": F.lag(side).over(along) for side in sides})
    kinds = dict(met.dtypes)
    shape = ", ".join(f"{c} {kinds[c]}" for c in (*keys, frame)) + "".join(f", {side} double" for side in sides)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [batch.column(c) for c in (*keys, frame)]
            made += [_change(batch.column(side), batch.column(f"{side}_before")) for side in sides]
            yield pa.RecordBatch.from_arrays(made, names=[*keys, frame, *sides])

    moved = met.select(*keys, frame, *sides, *(f"{side}_before" for side in sides)).mapInArrow(run, shape)
    return moved.groupBy(*keys, frame).agg(*(F.sum(side).alias(side) for side in sides))


def _change(now: pa.ListArray, before: pa.ListArray) -> pa.Array:
    """Summed absolute difference of each list to the one before; null where there is none."""
    has = np.array(before.is_valid())
    lengths = np.array(now.value_lengths().fill_null(0)), np.array(before.value_lengths().fill_null(0))
    if (lengths[0][has] != lengths[1][has]).any():
        raise ValueError("frames of a video differ in size")
    some = now.filter(pa.array(has)).flatten(), before.filter(pa.array(has)).flatten()
    moved = np.abs(some[0].to_numpy(zero_copy_only=False) - some[1].to_numpy(zero_copy_only=False))
    ends = np.cumsum(lengths[0][has])
    sums = np.zeros(len(has))
    sums[has] = np.add.reduceat(np.append(moved, 0.0), ends - lengths[0][has]) * (lengths[0][has] > 0)
    return pa.array(sums, mask=~has)


def transitions(
    pixels: DataFrame,
    keys: Sequence[str],
    frame: str,
    place: Sequence[str],
    sides: Sequence[str] = ("pred", "target"),
) -> DataFrame:
    """One row per key and frame: summed absolute change since the frame before.

    ``pixels`` has PU21 luminance in the columns named by ``sides``. The sequence of one
    pixel position is what is sorted, so a long video spreads over its pixels. The first
    frame has null changes.
    """
    along = Window.partitionBy(*keys, *place).orderBy(frame)
    moved = pixels.withColumns(
        {f"_d_{side}": F.abs(F.col(side) - F.lag(side).over(along)) for side in sides}
    )
    return moved.groupBy(*keys, frame).agg(*(F.sum(f"_d_{s}").alias(s) for s in sides))


def flicker(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Raw, reference and excess flicker per key; a single frame has none and says so."""
    means = steps.groupBy(*keys).agg(
        F.avg("pred").alias("flicker_raw"),
        F.avg("target").alias("flicker_reference"),
        F.count("pred").alias("_steps"),
    )
    excess: Column = F.col("flicker_raw") - F.col("flicker_reference")
    note = F.when(F.col("_steps") == 0, F.lit(SINGLE))
    return means.withColumns({"flicker_excess": excess, "temporal": note}).drop("_steps")
