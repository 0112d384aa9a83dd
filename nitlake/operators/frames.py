"""Operators on whole frames: one row per frame, a plane is an array in row-major order.

Neighbourhood operators run as Arrow-batched functions on the rows of a task; a frame never
leaves its row, so none of them shuffles. Index operators (crop, flip, pad, patches) are
plain array expressions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.common import RGB
from ..functions.light import saturation
from ..functions.spaces import PU21, PU21_PEAK, luma_2020
from ..functions.transfer import C1, C2, C3, M1, M2, PQ_NITS

# Type objects, not text, so that this module can be imported before a session exists.
NUMBER, PLANE = T.DoubleType(), T.ArrayType(T.DoubleType())

# The similarity window and its constants.
SSIM_TAPS, SSIM_SIGMA = 11, 1.5
SSIM_C1, SSIM_C2 = 0.01**2, 0.03**2


def _planes(values: pd.Series, heights: pd.Series, widths: pd.Series):
    for value, height, width in zip(values, heights, widths):
        yield np.asarray(value, dtype=float).reshape(int(height), int(width))


def _lists(planes) -> pd.Series:
    return pd.Series([np.ascontiguousarray(plane).ravel() for plane in planes], dtype=object)


def pu21_units(codes: np.ndarray) -> np.ndarray:
    """PU21 of gray PQ codes, scaled to its peak."""
    root = np.clip(codes, 1e-8, 1.0) ** (1 / M2)
    nits = PQ_NITS * (np.maximum(root - C1, 0) / (C2 - C3 * root)) ** (1 / M1)
    a, b, c, d, e, f, g = PU21
    power = np.clip(nits, 0.005, PQ_NITS) ** d
    return np.maximum(g * (((a + b * power) / (1 + c * power)) ** e - f), 0) / PU21_PEAK


def _window() -> np.ndarray:
    offsets = np.arange(SSIM_TAPS) - SSIM_TAPS // 2
    weights = np.exp(-(offsets**2) / (2 * SSIM_SIGMA**2))
    return weights / weights.sum()


def _blur(plane: np.ndarray) -> np.ndarray:
    """Gaussian blur of a plane or a stack of planes, rows then columns; what lies outside counts as zero."""
    reach = SSIM_TAPS // 2
    for axis in (-1, -2):
        margin = [(0, 0)] * plane.ndim
        margin[axis] = (reach, reach)
        wide = np.pad(plane, margin)
        length = plane.shape[axis]
        plane = sum(
            weight * np.take(wide, range(shift, shift + length), axis=axis)
            for shift, weight in enumerate(_window())
        )
    return plane


def similarity_map(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Structural similarity around every pixel of two planes of units."""
    mean_one, mean_other = _blur(one), _blur(other)
    spread = _blur(one * one) - mean_one**2 + _blur(other * other) - mean_other**2
    common = _blur(one * other) - mean_one * mean_other
    top = (2 * mean_one * mean_other + SSIM_C1) * (2 * common + SSIM_C2)
    bottom = (mean_one**2 + mean_other**2 + SSIM_C1) * (spread + SSIM_C2)
    return top / bottom


def _similarity(one: np.ndarray, other: np.ndarray) -> float:
    return float(np.mean(similarity_map(one, other)))


@F.pandas_udf(NUMBER)
def ssim_of_units(one: pd.Series, other: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
    """Structural similarity of two planes of PU21 luminance over its peak."""
    return pd.Series([_similarity(a, b) for a, b in zip(_planes(one, h, w), _planes(other, h, w))])


@F.pandas_udf(NUMBER)
def ssim_of_codes(one: pd.Series, other: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
    """As :func:`ssim_of_units`, for gray planes of PQ codes."""
    pairs = zip(_planes(one, h, w), _planes(other, h, w))
    return pd.Series([_similarity(pu21_units(a), pu21_units(b)) for a, b in pairs])


def sobel_log(wide: np.ndarray) -> np.ndarray:
    """log(1 + Sobel magnitude) of all but the outermost pixels."""
    rows, columns = wide.shape[0] - 2, wide.shape[1] - 2
    part = lambda dy, dx: wide[dy : dy + rows, dx : dx + columns]
    across = part(0, 2) + 2 * part(1, 2) + part(2, 2) - part(0, 0) - 2 * part(1, 0) - part(2, 0)
    down = part(2, 0) + 2 * part(2, 1) + part(2, 2) - part(0, 0) - 2 * part(0, 1) - part(0, 2)
    return np.log1p(np.sqrt((across / 4) ** 2 + (down / 4) ** 2 + 1e-12))


@F.pandas_udf(PLANE)
def log_gradient(plane: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
    """log(1 + Sobel magnitude); edges repeat their last value."""
    return _lists(sobel_log(np.pad(y, 1, mode="edge")) for y in _planes(plane, h, w))


def band_index(height: int, width: int, bands: int, left: int = 0, right: int | None = None) -> np.ndarray:
    """Ring of every coefficient of the half spectrum (or some of its columns), by distance from
    zero frequency."""
    down = np.abs(np.fft.fftfreq(height))[:, None]
    across = np.fft.rfftfreq(width)[None, :]
    most = np.sqrt(down.max() ** 2 + across.max() ** 2)
    radius = np.sqrt(down**2 + across[:, left:right] ** 2)
    radius = np.minimum(radius / max(most, 1e-8), 1 - 1e-6)
    return (radius * bands).astype(int)


def spectral_bands(bands: int = 8):
    """Log of the mean spectral power in ``bands`` rings of equal width."""

    @F.pandas_udf(PLANE)
    def run(plane: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        rings: dict[tuple[int, int], np.ndarray] = {}
        found = []
        for y in _planes(plane, h, w):
            ring = rings.setdefault(y.shape, band_index(*y.shape, bands)).ravel()
            power = np.abs(np.fft.rfft2(y, norm="ortho")).ravel() ** 2
            size = np.maximum(np.bincount(ring, minlength=bands), 1)
            found.append(np.log1p(np.bincount(ring, power, minlength=bands) / size))
        return _lists(found)

    return run


def _taps(count: int, wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower and upper neighbour and the share of the upper, half-pixel centres."""
    place = np.maximum((np.arange(wanted) + 0.5) * count / wanted - 0.5, 0)
    low = np.minimum(np.floor(place).astype(int), count - 1)
    return low, np.minimum(low + 1, count - 1), place - low


def tap_weights(count: int, wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(out, in, weight) of a bilinear resize along one axis: two taps, one where they fall together."""
    low, high, share = _taps(count, wanted)
    outs = np.repeat(np.arange(wanted), 2)
    ins, weights = np.stack([low, high], 1).ravel(), np.stack([1 - share, share], 1).ravel()
    used = weights > 0
    return outs[used], ins[used], weights[used]


def pool_weights(count: int, wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(out, in, weight) of the means over ``wanted`` cells of one axis; a cell has all it overlaps."""
    cells = np.arange(wanted)
    first, last = cells * count // wanted, -(-(cells + 1) * count // wanted)
    sizes = last - first
    outs = np.repeat(cells, sizes)
    ins = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first, sizes)
    return outs, ins, np.repeat(1 / sizes, sizes)


@F.pandas_udf(PLANE)
def bilinear(
    plane: pd.Series, h: pd.Series, w: pd.Series, to_h: pd.Series, to_w: pd.Series
) -> pd.Series:
    """Bilinear resize with half-pixel centres; a plane of the right size is kept."""

    def one(y: np.ndarray, rows: int, columns: int) -> np.ndarray:
        if y.shape == (rows, columns):
            return y
        top, bottom, down = _taps(y.shape[0], rows)
        left, right, across = _taps(y.shape[1], columns)
        upper = y[top][:, left] * (1 - across) + y[top][:, right] * across
        lower = y[bottom][:, left] * (1 - across) + y[bottom][:, right] * across
        return upper * (1 - down)[:, None] + lower * down[:, None]

    sizes = zip(to_h, to_w)
    return _lists(one(y, int(r), int(c)) for y, (r, c) in zip(_planes(plane, h, w), sizes))


@F.pandas_udf(PLANE)
def grid_pool(
    plane: pd.Series, h: pd.Series, w: pd.Series, rows: pd.Series, columns: pd.Series
) -> pd.Series:
    """Mean over the cells of a grid; cells overlap where the size does not divide."""

    def one(y: np.ndarray, r: int, c: int) -> np.ndarray:
        total = np.pad(y.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        y0, y1 = np.arange(r) * y.shape[0] // r, -(-(np.arange(r) + 1) * y.shape[0] // r)
        x0, x1 = np.arange(c) * y.shape[1] // c, -(-(np.arange(c) + 1) * y.shape[1] // c)
        box = lambda a, b: total[np.ix_(a, b)]
        summed = box(y1, x1) - box(y0, x1) - box(y1, x0) + box(y0, x0)
        return summed / np.outer(y1 - y0, x1 - x0)

    grid = zip(rows, columns)
    return _lists(one(y, int(r), int(c)) for y, (r, c) in zip(_planes(plane, h, w), grid))


def physical_maps(frames: DataFrame, planes: tuple[str, str, str]) -> DataFrame:
    """Add planes ``luminance``, ``gradient`` and ``saturation`` of linear BT.2020 planes."""
    pixels = F.arrays_zip(*(F.col(p).alias(c) for p, c in zip(planes, "rgb")))
    colour = lambda p: RGB(p["r"], p["g"], p["b"])
    frames = frames.withColumns(
        {
            "luminance": F.transform(pixels, lambda p: luma_2020(colour(p))),
            "saturation": F.transform(pixels, lambda p: saturation(colour(p))),
        }
    )
    return frames.withColumn(
        "gradient", log_gradient(F.col("luminance"), F.col("height"), F.col("width"))
    )


def picked(plane: Column, rows: Column, columns: Column, place) -> Column:
    """A new plane of rows x columns whose pixel (y, x) is ``plane[place(y, x)]``."""

    def one(i: Column) -> Column:
        y = F.floor(i / columns).cast("int")
        return F.get(plane, place(y, (i - y * columns).cast("int")))

    return F.transform(F.sequence(F.lit(0), rows * columns - 1), one)


def crop(plane: Column, h: Column, w: Column, top: Column, left: Column, size: int) -> Column:
    """A square cut; where the frame is too small its last row and column repeat."""
    side = F.lit(size)

    def place(y: Column, x: Column) -> Column:
        return F.least(top + y, h - 1) * w + F.least(left + x, w - 1)

    return picked(plane, side, side, place)


def crop_offset(drawn: Column, length: Column, size: int) -> Column:
    """A start for a cut, from a ticket; 0 where the frame is not longer than the cut."""
    return (drawn % (F.greatest(F.lit(0), length - F.lit(size)) + 1)).cast("int")


def mirrored(plane: Column, h: Column, w: Column) -> Column:
    return picked(plane, h, w, lambda y, x: y * w + (w - 1 - x))


@F.pandas_udf(PLANE)
def turned_units(plane: pd.Series, h: pd.Series, w: pd.Series, flipped: pd.Series, top: pd.Series) -> pd.Series:
    """Codes over ``top``, mirrored where ``flipped``."""
    turns = zip(_planes(plane, h, w), flipped, top)
    return _lists((y[:, ::-1] if turn else y) / most for y, turn, most in turns)


def padded_size(length: Column, multiple: int) -> Column:
    return (F.ceil(length / F.lit(multiple)) * multiple).cast("int")


def pad_to_multiple(plane: Column, h: Column, w: Column, multiple: int) -> Column:
    """Grow to the next multiple on the lower and right side by repeating the edge."""
    rows, columns = padded_size(h, multiple), padded_size(w, multiple)
    return picked(
        plane, rows, columns, lambda y, x: F.least(y, h - 1) * w + F.least(x, w - 1)
    )


def crop_back(plane: Column, padded_w: Column, h: Column, w: Column) -> Column:
    """Undo :func:`pad_to_multiple`, or cut to any smaller size from the top left."""
    return picked(plane, h, w, lambda y, x: y * padded_w + x)


def even_crop(plane: Column, h: Column, w: Column) -> Column:
    return crop_back(plane, w, h - h % 2, w - w % 2)


def patches(planes: list[Column], h: Column, w: Column) -> Column:
    """2x2 patches in reading order, each a vector over (channel, row, column)."""
    across = (w / 2).cast("int")

    def one(i: Column) -> Column:
        y = F.floor(i / across).cast("int") * 2
        x = (i % across).cast("int") * 2
        return F.array(
            *(F.get(p, (y + dy) * w + x + dx) for p in planes for dy in (0, 1) for dx in (0, 1))
        )

    return F.transform(F.sequence(F.lit(0), (h / 2).cast("int") * across - 1), one)


def unpatch(packed: Column, channel: int, h: Column, w: Column) -> Column:
    """One plane back from :func:`patches`."""
    across = (w / 2).cast("int")

    def one(i: Column) -> Column:
        y = F.floor(i / w).cast("int")
        x = (i % w).cast("int")
        patch = F.get(packed, F.floor(y / 2).cast("int") * across + F.floor(x / 2).cast("int"))
        return F.get(patch, F.lit(channel * 4) + (y % 2) * 2 + x % 2)

    return F.transform(F.sequence(F.lit(0), h * w - 1), one)


def to_pixels(frames: DataFrame, keep: list[str], planes: dict[str, str]) -> DataFrame:
    """One row per pixel with ``y``, ``x`` and the named planes; needs height and width.

    All pixels of a frame come from one row of one task, so a later reduction per frame is
    finished before the shuffle.
    """
    zipped = F.arrays_zip(*(F.col(plane).alias(name) for name, plane in planes.items()))
    spread = frames.select(*keep, F.col("width").alias("_w"), F.posexplode(zipped).alias("_i", "_z"))
    place = F.col("_i")
    return spread.select(
        *keep,
        F.floor(place / F.col("_w")).cast("int").alias("y"),
        (place % F.col("_w")).cast("int").alias("x"),
        *(F.col(f"_z.{name}").alias(name) for name in planes),
    )


def spread_pixels(frames: DataFrame, keep: list[str], planes: dict[str, str]) -> DataFrame:
    """Pixels in order, marked with ``_row`` and ``_count`` so that :func:`repack` can undo it."""
    first = next(iter(planes.values()))
    marked = frames.withColumns(
        {"_row": F.monotonically_increasing_id(), "_count": F.size(first)}
    )
    zipped = F.arrays_zip(*(F.col(plane).alias(name) for name, plane in planes.items()))
    spread = marked.select("_row", "_count", *keep, F.explode(zipped).alias("_z"))
    return spread.select("_row", "_count", *keep, *(F.col(f"_z.{n}").alias(n) for n in planes))


def repack(pixels: DataFrame, keep: list[str], planes: list[str], kind: str = "int") -> DataFrame:
    """Frames from pixels that are still in the partition and order they were spread in.

    Only projections may lie between the two. Nothing is shuffled: a frame is closed when its
    last pixel has arrived, and a frame that is broken up is an error, not a wrong picture.
    """
    types = dict(pixels.select(*keep).dtypes)
    schema = ", ".join(f"{name} {types[name]}" for name in keep)
    schema += "".join(f", {name} array<{kind}>" for name in planes)

    def run(batches):
        held: list[pd.DataFrame] = []
        for batch in batches:
            done = []
            for _, rows in batch.groupby("_row", sort=False):
                if held and held[0]["_row"].iloc[0] != rows["_row"].iloc[0]:
                    raise ValueError("pixels of a frame are not together")
                held.append(rows)
                if sum(map(len, held)) == rows["_count"].iloc[0]:
                    whole = pd.concat(held) if len(held) > 1 else held[0]
                    values = {name: whole[name].iloc[0] for name in keep}
                    done.append({**values, **{n: whole[n].to_numpy() for n in planes}})
                    held = []
            if done:
                yield pd.DataFrame(done, columns=[*keep, *planes])
        if held:
            raise ValueError("pixels of a frame are missing")

    return pixels.select("_row", "_count", *keep, *planes).mapInPandas(run, schema)


def predict_frames(frames: DataFrame, fn, planes: tuple[str, str, str], out: tuple[str, str, str]):
    """Run a user's ``fn(frame: (3, h, w) array) -> (3, h, w) array`` on every frame row.

    Adds the ``out`` planes and ``out_height``, ``out_width``. The function travels to the
    tasks; frames come in Arrow batches and stay in their partition.
    """
    fields = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in frames.schema)
    schema = f"{fields}, " + ", ".join(f"{name} array<double>" for name in out)
    schema += ", out_height int, out_width int"

    def run(batches):
        for batch in batches:
            results = []
            for row in batch.itertuples(index=False):
                shape = (int(row.height), int(row.width))
                frame = np.stack([np.asarray(getattr(row, p), float).reshape(shape) for p in planes])
                results.append(np.asarray(fn(frame), dtype=float))
            added = {
                name: [result[channel].ravel() for result in results]
                for channel, name in enumerate(out)
            }
            yield batch.assign(
                **added,
                out_height=[r.shape[1] for r in results],
                out_width=[r.shape[2] for r in results],
            )

    return frames.mapInPandas(run, schema)
