"""Frames as tiles: a tile is one row, so that no task needs a whole frame.

A tile row has the keys of its frame, the frame's ``height`` and ``width``, ``tile`` (the side of a
full tile), ``tile_row`` and ``tile_column``, and planes in row-major order. Tiles of the last row and
column are smaller where the side does not divide.

What needs pixels of other tiles gets them as pieces: the part of a tile that meets a wanted
rectangle is cut out where the tile lies, and only that part is shuffled. A rectangle is put together
by the task that uses it, and is as large as a tile with its edges, or as a crop.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import cut
from .attach import attach
from .frames import SSIM_TAPS, band_index, pool_weights, pu21_units, similarity_map, sobel_log, tap_weights

TILE = 256
GRID = ("height", "width", "tile", "tile_row", "tile_column")
#: Keys that are pushed to the scan by name, one by one; more are only joined.
NAMED = 200
#: Pixels of one batch that is made here.
PIXELS = 500_000
#: Pixels of small tiles that are worked on together, as one call for each tile costs more than its pixels.
STACKED = 20_000
#: About as many windows of one tile travel with it in one row; a tile that more ask for is joined again.
ASKED = 64

Rect = tuple[int, int, int, int]  # top, left, bottom, right; the last two are not included


def _side(frame: int, tile: int, at: int) -> int:
    return max(min(tile, frame - at * tile), 0)


def _rect(height: int, width: int, tile: int, row: int, column: int) -> Rect:
    top, left = row * tile, column * tile
    return top, left, top + _side(height, tile, row), left + _side(width, tile, column)


def _met(one: Rect, other: Rect) -> Rect:
    return max(one[0], other[0]), max(one[1], other[1]), min(one[2], other[2]), min(one[3], other[3])


def _around(rect: Rect, reach: int, height: int, width: int) -> Rect:
    grown = rect[0] - reach, rect[1] - reach, rect[2] + reach, rect[3] + reach
    return _met(grown, (0, 0, height, width))


def _part(plane: np.ndarray, own: Rect, wanted: Rect) -> np.ndarray:
    """The pixels of ``wanted``, which lies in ``own``, the place of ``plane`` in its frame."""
    values = plane.reshape(own[2] - own[0], own[3] - own[1])
    return values[wanted[0] - own[0] : wanted[2] - own[0], wanted[1] - own[1] : wanted[3] - own[1]]


def _lists(column: pa.Array) -> list[np.ndarray]:
    """The lists of a column as arrays, without a copy."""
    if column.null_count:
        raise ValueError("a frame has no pixels")
    flat, ends = column.flatten(), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(flat.to_numpy(zero_copy_only=False), ends[:-1]) if len(column) else []


def _fields(df: DataFrame, names: Sequence[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{name}` {kinds[name]}" for name in names)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about as many pixels as Arrow batches of a few megabytes hold."""
    held, pixels = [], 0
    for row in rows:
        held.append(row)
        pixels += sum(value.size for value in row if isinstance(value, np.ndarray))
        if pixels >= PIXELS or len(held) >= 5000:
            yield _batch(held, schema)
            held, pixels = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    arrays = [_column(values, field.type) for values, field in zip(zip(*rows, strict=True), schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _column(values: tuple, kind: pa.DataType) -> pa.Array:
    if not isinstance(values[0], np.ndarray):
        return pa.array(values, kind)
    ends = np.cumsum([0, *(v.size for v in values)]).astype(np.int32)
    flat = pa.array(np.concatenate(values), kind.value_type)
    return pa.ListArray.from_arrays(pa.array(ends), flat).cast(kind)


def _arrow(df: DataFrame, names: Sequence[str], also: Sequence[tuple[str, pa.DataType]] = ()) -> pa.Schema:
    return pa.schema([*to_arrow_schema(df.select(*names).schema), *[pa.field(n, t) for n, t in also]])


def to_tiles(frames: DataFrame, keys: Sequence[str], planes: Sequence[str], size: int = TILE) -> DataFrame:
    """Frames with ``height``, ``width`` and ``planes`` cut to tiles of ``size`` by ``size``.

    A frame without pixels has no tiles; a plane that is null or of another size is an error.
    """
    if size < 1:
        raise ValueError("a tile needs a side of at least 1")
    own = [*keys, "height", "width"]
    grid = [(name, pa.int32()) for name in GRID[2:]]
    schema = _arrow(frames, own, grid)
    schema = pa.schema([*schema, *_arrow(frames, planes)])
    out = f"{_fields(frames, own)}, tile int, tile_row int, tile_column int, {_fields(frames, planes)}"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            held = [_lists(batch.column(name)) for name in planes]
            names = [batch.column(name).to_pylist() for name in own]
            for i in range(batch.num_rows):
                head = [values[i] for values in names]
                height, width = head[-2:]
                whole = [plane[i].reshape(height, width) for plane in held]
                for row in range(-(-height // size)):
                    for c in range(-(-width // size)):
                        a, b, y, x = _rect(height, width, size, row, c)
                        yield *head, size, row, c, *(p[a:y, b:x].ravel() for p in whole)

    return frames.select(*own, *planes).mapInArrow(lambda batches: _batches(rows(batches), schema), out)


def write_tiles(tiles: DataFrame, path: str, keys: Sequence[str], page_rows: int = 16) -> None:
    """Tiles as a Parquet table whose files, row groups and pages are ranges of key and place.

    Small pages of the key columns let a reader with pushed filters leave out pages, not only files.
    """
    order = [*keys, "tile_row", "tile_column"]
    placed = tiles.repartitionByRange(*order).sortWithinPartitions(*order)
    writer = placed.write.option("parquet.page.row.count.limit", page_rows)
    writer.option("parquet.block.size", 32 << 20).parquet(path)


def frame_sizes(store: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, height, width, tile) of every stored frame: the first tiles, and no plane of them."""
    return store.where("tile_row = 0 AND tile_column = 0").select(*keys, "height", "width", "tile")


def tiles_within(store: DataFrame, keys: Sequence[str], wanted: DataFrame) -> DataFrame:
    """The rows of ``store`` that may be ``wanted`` by (keys, tile_row, tile_column).

    The range of places, and the keys where there are at most ``NAMED``, are literals of the filter,
    so that they reach the scan. It only leaves out: joining with ``wanted`` gives the same rows.
    """
    sides = [F.min("tile_row"), F.max("tile_row"), F.min("tile_column"), F.max("tile_column")]
    low, high, left, right = wanted.agg(*sides).first()
    if low is None:
        return store.where(F.lit(False))
    found = store.where(F.col("tile_row").between(low, high) & F.col("tile_column").between(left, right))
    for key in keys:
        named = [row[0] for row in wanted.select(key).distinct().limit(NAMED + 1).collect()]
        if len(named) <= NAMED:
            found = found.where(F.col(key).isin(named))
    return found


def _grouped(pieces: DataFrame, keys: Sequence[str], planes: Sequence[str], kept: Sequence[str]) -> DataFrame:
    parts = F.collect_list(F.struct("_top", "_left", "_rows", "_columns", *planes)).alias("_pieces")
    return pieces.groupBy(*keys, *kept).agg(parts)


_PIECE = [(name, pa.int32()) for name in ("_top", "_left", "_rows", "_columns")]
_PIECE_SQL = "_top int, _left int, _rows int, _columns int"


def _put_together(batch: pa.RecordBatch, planes: Sequence[str]) -> Iterator[tuple[int, int, int, list[np.ndarray]]]:
    """(top, left of the rectangle, row of the batch, planes) of every row with ``_pieces``."""
    lists = batch.column("_pieces")
    counts = lists.value_lengths().to_numpy(zero_copy_only=False)
    fields = lists.flatten().flatten()
    tops, lefts, rows, columns = (f.to_numpy(zero_copy_only=False) for f in fields[:4])
    held = [_lists(field) for field in fields[4:]]
    ends = np.cumsum(counts)
    for i, (start, end) in enumerate(zip(ends - counts, ends, strict=True)):
        some = range(start, end)
        top, left = tops[start:end].min(), lefts[start:end].min()
        bottom, right = (tops[start:end] + rows[start:end]).max(), (lefts[start:end] + columns[start:end]).max()
        if (rows[start:end].astype(np.int64) * columns[start:end]).sum() != (bottom - top) * (right - left):
            raise ValueError("tiles of a frame are missing or repeated")
        whole = []
        for plane in held:
            made = np.empty((bottom - top, right - left), plane[start].dtype)
            for j in some:
                y, x = tops[j] - top, lefts[j] - left
                made[y : y + rows[j], x : x + columns[j]] = plane[j].reshape(rows[j], columns[j])
            whole.append(made)
        yield int(top), int(left), i, whole


def with_edges(
    tiles: DataFrame,
    keys: Sequence[str],
    planes: Sequence[str],
    reach: int,
    work: Callable[[list[np.ndarray], tuple[tuple[int, int], tuple[int, int]]], Sequence],
    out: Sequence[tuple[str, pa.DataType, str]],
    stacked: bool = False,
) -> DataFrame:
    """Run ``work`` on every tile with ``reach`` pixels of its neighbours around it.

    Each tile sends itself to its own place and its edges to the tiles around it, as far as ``reach``
    goes. ``work(planes, missing)`` gets the planes as far as they lie in the frame and, per axis, how
    many pixels are missing before and after: only at the frame's edge. What it returns are the ``out``
    fields (name, Arrow type, SQL type) of the tile's row, which keeps its keys and place. With ``stacked``
    it gets the planes of several tiles that are alike in size and place in the frame, one behind the
    other, and returns the fields of each.
    """
    own = [*keys, *GRID]
    schema = pa.schema([*_arrow(tiles, own, _PIECE), *_arrow(tiles, planes)])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            held = [_lists(batch.column(name)) for name in planes]
            names = [batch.column(name).to_pylist() for name in own]
            for i in range(batch.num_rows):
                *head, height, width, tile, row, column = (values[i] for values in names)
                rect = _rect(height, width, tile, row, column)
                far = -(-reach // tile)
                for r in range(max(row - far, 0), min(row + far, (height - 1) // tile) + 1):
                    for c in range(max(column - far, 0), min(column + far, (width - 1) // tile) + 1):
                        wanted = _around(_rect(height, width, tile, r, c), reach, height, width)
                        a, b, y, x = meet = _met(rect, wanted)
                        if a < y and b < x:
                            parts = [_part(plane[i], rect, meet).ravel() for plane in held]
                            yield *head, height, width, tile, r, c, a, b, y - a, x - b, *parts

    sent = tiles.select(*own, *planes).mapInArrow(lambda batches: _batches(send(batches), schema), f"{_fields(tiles, own)}, {_PIECE_SQL}, {_fields(tiles, planes)}")
    made = pa.schema([*_arrow(tiles, own), *[pa.field(name, kind) for name, kind, _ in out]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            names = [batch.column(name).to_pylist() for name in own]
            alike: dict[tuple, list] = {}
            for top, left, i, whole in _put_together(batch, planes):
                head = tuple(values[i] for values in names)
                a, b, y, x = _rect(*head[-5:])
                bottom, right = top + whole[0].shape[0], left + whole[0].shape[1]
                missing = (reach - (a - top), reach - (bottom - y)), (reach - (b - left), reach - (right - x))
                if not stacked:
                    yield *head, *work(whole, missing)
                    continue
                held = alike.setdefault((whole[0].shape, missing), [])
                held.append((head, whole))
                if len(held) * whole[0].size >= STACKED:
                    yield from together(alike.pop((whole[0].shape, missing)), missing)
            for (_, missing), held in alike.items():
                yield from together(held, missing)

    def together(held: list, missing: tuple) -> Iterator[tuple]:
        heads, wholes = zip(*held, strict=True)
        for head, fields in zip(heads, work([np.stack(plane) for plane in zip(*wholes, strict=True)], missing), strict=True):
            yield *head, *fields

    fields = ", ".join(f"`{name}` {kind}" for name, _, kind in out)
    grouped = _grouped(sent, own, planes, [])
    return grouped.mapInArrow(lambda batches: _batches(run(batches), made), f"{_fields(tiles, own)}, {fields}")


def log_gradient(tiles: DataFrame, keys: Sequence[str], plane: str, out: str = "gradient") -> DataFrame:
    """Tiles of log(1 + Sobel magnitude); the frame's edge repeats its last value."""

    def work(planes, missing):
        return [sobel_log(np.pad(planes[0].astype(float), missing, mode="edge")).ravel()]

    return with_edges(tiles, keys, [plane], 1, work, [(out, pa.list_(pa.float64()), "array<double>")])


def ssim(tiles: DataFrame, keys: Sequence[str], one: str, other: str, codes: bool = True, out: str = "ssim") -> DataFrame:
    """Structural similarity per frame of two planes: gray PQ codes, or PU21 units over their peak.

    Tiles sum their own pixels; what lies outside the frame counts as zero.
    """
    reach = SSIM_TAPS // 2

    def work(planes, missing):
        units = [pu21_units(p.astype(float)) if codes else p.astype(float) for p in planes]
        alike = similarity_map(*(np.pad(p, ((0, 0), *missing)) for p in units))[:, reach:-reach, reach:-reach]
        return [(float(one.sum()), one.size) for one in alike]

    fields = [("_sum", pa.float64(), "double"), ("_pixels", pa.int64(), "bigint")]
    found = with_edges(tiles, keys, [one, other], reach, work, fields, stacked=True)
    return found.groupBy(*keys).agg((F.sum("_sum") / F.sum("_pixels")).alias(out))


def spectral_bands(tiles: DataFrame, keys: Sequence[str], plane: str, bands: int = 8) -> DataFrame:
    """(keys, band, energy): log of the mean spectral power in rings, of frames in tiles.

    Two passes: strips of ``tile`` rows are transformed along their rows, cut across into strips of
    ``tile`` frequencies that are transformed along their columns, and rings are summed by key. A task
    holds one strip, never a frame. Rings without a coefficient have no energy: their row says 0.
    """
    frame = [*keys, "height", "width", "tile"]
    pieces = _own_pieces(tiles, keys, [plane])
    schema = pa.schema([*_arrow(tiles, [*frame, "tile_column"], _PIECE), ("re", pa.list_(pa.float64())), ("im", pa.list_(pa.float64()))])

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            names = [batch.column(name).to_pylist() for name in frame]
            for top, _, i, (strip,) in _put_together(batch, [plane]):
                head = [values[i] for values in names]
                found = np.fft.rfft(strip.astype(float), axis=1, norm="ortho")
                for c, at in enumerate(range(0, found.shape[1], head[-1])):
                    part = found[:, at : at + head[-1]]
                    yield *head, c, top, at, *part.shape, part.real.ravel(), part.imag.ravel()

    strips = _grouped(pieces, frame, [plane], ["tile_row"])
    shape = f"{_fields(tiles, [*frame, 'tile_column'])}, {_PIECE_SQL}, re array<double>, im array<double>"
    parts = strips.mapInArrow(lambda batches: _batches(along(batches), schema), shape)
    turned = _grouped(parts, frame, ["re", "im"], ["tile_column"])
    rings = pa.schema([*_arrow(tiles, keys), ("band", pa.int64()), ("_power", pa.float64()), ("_count", pa.int64())])

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            names = [batch.column(name).to_pylist() for name in frame]
            for _, left, i, (re, im) in _put_together(batch, ["re", "im"]):
                *head, height, width, _tile = (values[i] for values in names)
                power = np.abs(np.fft.fft(re + 1j * im, axis=0, norm="ortho")) ** 2
                ring = band_index(height, width, bands, left, left + re.shape[1]).ravel()
                count, total = np.bincount(ring, minlength=bands), np.bincount(ring, power.ravel(), minlength=bands)
                for band in range(bands):
                    yield *head, band, float(total[band]), int(count[band])

    summed = turned.mapInArrow(lambda batches: _batches(down(batches), rings), f"{_fields(tiles, keys)}, band bigint, _power double, _count bigint")
    mean = F.sum("_power") / F.greatest(F.sum("_count"), F.lit(1))
    return summed.groupBy(*keys, "band").agg(F.log1p(mean).alias("energy"))


def _own_pieces(tiles: DataFrame, keys: Sequence[str], planes: Sequence[str]) -> DataFrame:
    """Every tile as one whole piece of its frame."""
    top, left = F.col("tile_row") * F.col("tile"), F.col("tile_column") * F.col("tile")
    sides = [F.least(F.col("tile"), F.col(n) - at).cast("int") for n, at in (("height", top), ("width", left))]
    places = [c.alias(n) for c, (n, _) in zip((top, left, *sides), _PIECE, strict=True)]
    return tiles.select(*keys, *GRID, *places, *planes)


def _along(plane: np.ndarray, table: tuple, first: int) -> tuple[np.ndarray, int, np.ndarray]:
    """Weighted sums along the last axis of a tile whose columns begin at ``first`` of the frame.

    ``table`` is (out, in, weight), sorted by out. Gives the sums of all outs that the tile has a part
    in, the first of these, and the weight that the tile has in each.
    """
    outs, ins, weights = table
    met = (ins >= first) & (ins < first + plane.shape[-1])
    outs, ins, weights = outs[met], ins[met] - first, weights[met]
    if not len(outs):
        return np.zeros((plane.shape[0], 0)), 0, np.zeros(0)
    starts = np.flatnonzero(np.diff(outs, prepend=-1))
    sums = np.zeros((plane.shape[0], outs[-1] + 1 - outs[0]))
    sums[:, outs[starts] - outs[0]] = np.add.reduceat(plane[:, ins] * weights, starts, axis=1)
    return sums, int(outs[0]), np.bincount(outs - outs[0], weights)


def weighted(
    tiles: DataFrame,
    keys: Sequence[str],
    plane: str,
    weights: Callable[[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]],
    height: int,
    width: int,
    out: str = "out",
    size: int | None = None,
) -> DataFrame:
    """Frames in tiles of another size, ``height`` by ``width``, as weighted sums along both axes.

    ``weights(count, wanted)`` is the sparse table of an axis: (out, in, weight), sorted by out, where
    the weights of an out add up to one. A tile sums its own pixels along its columns, then its rows;
    only these sums leave it, cut by the tiles (of ``size``, as before if not given) they belong to,
    and are added by key. So a frame that shrinks sends less than it has, and no task holds one.
    """
    if height < 1 or width < 1:
        raise ValueError("a frame has at least one row and one column")
    own = [*keys, *GRID]
    schema = pa.schema([*_arrow(tiles, keys), *[pa.field(n, pa.int32()) for n in GRID], *[pa.field(n, t) for n, t in _PIECE], pa.field("_weight", pa.float64()), pa.field(out, pa.list_(pa.float64()))])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        axis = functools.lru_cache(maxsize=64)(weights)
        for batch in batches:
            held = _lists(batch.column(plane))
            names = [batch.column(name).to_pylist() for name in own]
            for i in range(batch.num_rows):
                *head, h, w, tile, row, column = (values[i] for values in names)
                top, left, bottom, right = _rect(h, w, tile, row, column)
                values = held[i].reshape(bottom - top, right - left).astype(float)
                across, x, part_x = _along(values, axis(w, width), left)
                down, y, part_y = _along(across.T, axis(h, height), top)
                sums, side = down.T, size or tile
                rows, columns = sums.shape
                for r in range(y // side, -(-(y + rows) // side) if columns else 0):
                    a, b = max(r * side, y), min((r + 1) * side, y + rows)
                    for c in range(x // side, -(-(x + columns) // side) if rows else 0):
                        d, e = max(c * side, x), min((c + 1) * side, x + columns)
                        part = float(part_y[a - y : b - y].sum() * part_x[d - x : e - x].sum())
                        cut_out = sums[a - y : b - y, d - x : e - x].ravel()
                        yield *head, height, width, side, r, c, a, d, b - a, e - d, part, cut_out

    grid = ", ".join(f"{name} int" for name in GRID)
    shape = f"{_fields(tiles, keys)}, {grid}, {_PIECE_SQL}, _weight double, `{out}` array<double>"
    sent = tiles.select(*own, plane).mapInArrow(lambda batches: _batches(send(batches), schema), shape)
    made = pa.schema([*_arrow(tiles, keys), *[pa.field(n, pa.int32()) for n in GRID], pa.field(out, pa.list_(pa.float64()))])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            names = [batch.column(name).to_pylist() for name in own]
            pieces = batch.column("_pieces")
            ends = np.cumsum(pieces.value_lengths().to_numpy(zero_copy_only=False))
            fields = pieces.flatten().flatten()
            tops, lefts, rows, columns, parts = (f.to_numpy(zero_copy_only=False) for f in fields[:5])
            held = _lists(fields[5])
            for i, (start, end) in enumerate(zip(np.append(0, ends[:-1]), ends, strict=True)):
                head = [values[i] for values in names]
                a, b, y, x = _rect(*head[-5:])
                total = np.zeros((y - a, x - b))
                # In order of place, so that the sum is the same whatever the order of arrival.
                for j in start + np.lexsort((parts[start:end], lefts[start:end], tops[start:end])):
                    at_y, at_x = tops[j] - a, lefts[j] - b
                    total[at_y : at_y + rows[j], at_x : at_x + columns[j]] += held[j].reshape(rows[j], columns[j])
                if abs(parts[start:end].sum() - total.size) > 1e-6 * total.size:
                    raise ValueError("tiles of a frame are missing or repeated")
                yield *head, total.ravel()

    parts = F.collect_list(F.struct(*(n for n, _ in _PIECE), "_weight", F.col(f"`{out}`"))).alias("_pieces")
    grouped = sent.groupBy(*own).agg(parts)
    return grouped.mapInArrow(lambda batches: _batches(add(batches), made), f"{_fields(tiles, keys)}, {grid}, `{out}` array<double>")


def resized(tiles: DataFrame, keys: Sequence[str], plane: str, height: int, width: int, out: str = "out", size: int | None = None) -> DataFrame:
    """Bilinear resize with half-pixel centres, of frames in tiles."""
    return weighted(tiles, keys, plane, tap_weights, height, width, out, size)


def pooled(tiles: DataFrame, keys: Sequence[str], plane: str, rows: int, columns: int, out: str = "out", size: int | None = None) -> DataFrame:
    """Mean over the cells of a grid, of frames in tiles; cells overlap where the size does not divide."""
    return weighted(tiles, keys, plane, pool_weights, rows, columns, out, size)


def crops(
    store: DataFrame,
    keys: Sequence[str],
    windows: DataFrame,
    records: Sequence[str],
    planes: Sequence[str],
    size: int,
) -> DataFrame:
    """Square cuts of stored frames: (records, planes), a plane of ``size`` by ``size`` each.

    ``windows`` has one row per record: its ``records`` columns, which tell it from others, the
    frame's ``keys``, and ``top`` and ``left`` inside the frame. Only tiles that a window meets are
    joined, and only the pixels of the window leave them. Where a frame is smaller than the cut, its
    last row and column repeat. Windows of frames that are not stored have no row.
    """
    sized = windows.select(*records, *[k for k in keys if k not in records], "top", "left")
    sized = attach(sized, frame_sizes(store, keys), keys)
    last = lambda at, side: F.least(F.col(at) + F.lit(size), F.col(side)) - 1
    span = lambda at, side: F.sequence(
        F.floor(F.col(at) / F.col("tile")).cast("int"), F.floor(last(at, side) / F.col("tile")).cast("int")
    )
    wanted = sized.withColumn("tile_row", F.explode(span("top", "height")))
    wanted = wanted.withColumn("tile_column", F.explode(span("left", "width"))).drop("height", "width", "tile")
    wanted = cut(wanted)
    place = [*keys, "tile_row", "tile_column"]
    asked = F.collect_list(F.struct(*records, "top", "left")).alias("_asked")
    most = wanted.groupBy(*place).count().agg(F.max("count")).first()[0] or 0
    slot = F.pmod(F.xxhash64(*records), F.lit(most // ASKED + 1))
    asks = wanted.groupBy(*place, slot.alias("_slot")).agg(asked).drop("_slot")
    some = tiles_within(store, keys, wanted).select(*keys, *GRID, *planes)
    met = attach(some, asks, place)
    schema = pa.schema([*_arrow(windows, records, _PIECE), *_arrow(store, planes)])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            held = [_lists(batch.column(name)) for name in planes]
            names = [batch.column(name).to_pylist() for name in GRID]
            for i, asked in enumerate(batch.column("_asked").to_pylist()):
                height, width, *_ = grid = [values[i] for values in names]
                rect = _rect(*grid)
                for one in asked:
                    top, left = one["top"], one["left"]
                    a, b, y, x = meet = _met(rect, (top, left, min(top + size, height), min(left + size, width)))
                    cuts = [_part(plane[i], rect, meet).ravel() for plane in held]
                    yield *(one[name] for name in records), a, b, y - a, x - b, *cuts

    shape = f"{_fields(windows, records)}, {_PIECE_SQL}, {_fields(store, planes)}"
    pieces = met.select(*GRID, *planes, "_asked").mapInArrow(lambda batches: _batches(send(batches), schema), shape)
    made = pa.schema([*_arrow(windows, records), *_arrow(store, planes)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            names = [batch.column(name).to_pylist() for name in records]
            for _, _, i, whole in _put_together(batch, planes):
                short = [(0, size - n) for n in whole[0].shape]
                yield *(values[i] for values in names), *(np.pad(p, short, mode="edge").ravel() for p in whole)

    grouped = _grouped(pieces, records, planes, [])
    return grouped.mapInArrow(lambda batches: _batches(run(batches), made), f"{_fields(windows, records)}, {_fields(store, planes)}")
