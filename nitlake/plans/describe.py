"""Physical description of SDR frames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.common import RGB
from ..functions.light import sdr_light
from ..operators import describe
from ..operators.frames import grid_pool, physical_maps, spectral_bands


@dataclass
class Description:
    """Global statistics, maps, spectral bands."""

    stats: DataFrame
    maps: DataFrame
    bands: DataFrame


def linear_planes(frames: DataFrame) -> DataFrame:
    """SDR planes ``r g b`` to planes of linear BT.2020 light."""
    zipped = F.arrays_zip(*(F.col(c).alias(c) for c in "rgb"))
    lit = F.transform(
        zipped,
        lambda p: F.struct(
            *(v.alias(c) for v, c in zip(sdr_light(RGB(p["r"], p["g"], p["b"])), "rgb"))
        ),
    )
    moved = frames.withColumn("_lit", lit)
    return moved.withColumns({c: F.col("_lit")[c] for c in "rgb"}).drop("_lit")


def describe_frames(frames: DataFrame, keys: list[str], bands: int = 8) -> Description:
    """Describe frames with SDR planes ``r g b``, ``height`` and ``width``."""
    maps = physical_maps(linear_planes(frames), ("r", "g", "b"))
    size = (F.col("height"), F.col("width"))
    spectrum = maps.select(*keys, spectral_bands(bands)("luminance", *size).alias("bands"))
    values = maps.select(*keys, F.explode("luminance").alias("y"))
    stats = describe.global_stats(values, keys, "y")
    kept = maps.select(*keys, "height", "width", "luminance", "gradient", "saturation")
    return Description(stats, kept, spectrum)


def to_grid(maps: DataFrame, keys: list[str], rows: int, columns: int) -> DataFrame:
    """The three maps pooled to a grid."""
    size = (F.col("height"), F.col("width"), F.lit(rows), F.lit(columns))
    names = ("luminance", "gradient", "saturation")
    return maps.select(*keys, *(grid_pool(F.col(n), *size).alias(n) for n in names))
