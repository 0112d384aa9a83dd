"""Models on frames: loaded once a worker, run on batches of frames of one shape.

A frame stays in its partition. A task sorts the frames that come to it by shape, and runs the model
on one array as soon as it holds enough pixels of a shape.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

#: Pixels of a plane that a batch is gathered to.
PIXELS = 2_000_000

#: Models of this worker process, newest last, and how many it keeps: a worker may serve two in turn.
_LOADED: dict[str, Callable] = {}
KEPT = 2


@dataclass(frozen=True)
class Model:
    """``load()``, called once a worker, gives a function of arrays of frames of one shape.

    A model of frames maps (n, 3, height, width) to (n, 3, any height, any width); a scorer maps two
    such arrays, prediction and target, to n numbers. ``pixels`` bounds a batch from above by this many
    pixels of a plane or one frame, whichever is more.
    """

    load: Callable[[], Callable]
    pixels: int = PIXELS
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def ready(self) -> Callable:
        """The loaded model of this worker."""
        if self.name not in _LOADED:
            while len(_LOADED) >= KEPT:
                del _LOADED[next(iter(_LOADED))]
            _LOADED[self.name] = self.load()
        return _LOADED[self.name]


def _stacked(batch: pa.RecordBatch, planes: Sequence[str], height: int, width: int) -> np.ndarray:
    """(rows, planes, height, width) of rows of one shape."""
    stack = np.empty((batch.num_rows, len(planes), height, width))
    for i, name in enumerate(planes):
        column = batch.column(name)
        sizes = column.value_lengths().to_numpy(zero_copy_only=False)
        if column.null_count or (sizes != height * width).any():
            raise ValueError(f"plane {name} is null or not of the size of its frame")
        stack[:, i] = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, height, width)
    return stack


def _of_one_shape(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.RecordBatch, int, int]]:
    """Rows in batches of one (height, width), of about ``most`` pixels; never more than that are held back
    but for what the last Arrow batch brought."""
    held: dict[tuple[int, int], list[pa.RecordBatch]] = {}
    pixels: dict[tuple[int, int], int] = {}

    def whole(shape: tuple[int, int]) -> Iterator[tuple[pa.RecordBatch, int, int]]:
        table = pa.Table.from_batches(held.pop(shape)).combine_chunks()
        del pixels[shape]
        rows = max(most // max(shape[0] * shape[1], 1), 1)
        for part in table.to_batches(max_chunksize=rows):
            yield part, *shape

    for batch in batches:
        sides = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in ("height", "width")], 1)
        if np.isnan(sides.astype(float)).any():
            raise ValueError("a frame has no height or no width")
        shapes, of = np.unique(sides.astype(int), axis=0, return_inverse=True)
        for i, shape in enumerate(map(tuple, shapes.tolist())):
            rows = batch.take(pa.array(np.flatnonzero(of.ravel() == i)))
            held.setdefault(shape, []).append(rows)
            pixels[shape] = pixels.get(shape, 0) + rows.num_rows * shape[0] * shape[1]
        while pixels and sum(pixels.values()) >= most:
            yield from whole(max(pixels, key=pixels.get))
    for shape in list(held):
        yield from whole(shape)


def _fields(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema)


def _flat(planes: np.ndarray) -> pa.Array:
    """(rows, height, width) as lists."""
    ends = np.arange(len(planes) + 1, dtype=np.int32) * (planes.shape[1] * planes.shape[2])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.ascontiguousarray(planes, dtype=float).ravel()))


def model_frames(frames: DataFrame, model: Model, planes: Sequence[str], out: Sequence[str]) -> DataFrame:
    """Add the planes ``out`` that ``model`` makes of ``planes``, and ``out_height``, ``out_width``.

    Rows stay in their partition, in an order of their own. A null plane, or one that is not of the
    ``height`` and ``width`` of its row, is an error; so is a result of another number of frames.
    """
    keep, kinds = frames.columns, to_arrow_schema(frames.schema)
    made = [*kinds, *[pa.field(n, pa.list_(pa.float64())) for n in out], pa.field("out_height", pa.int32()), pa.field("out_width", pa.int32())]
    schema = f"{_fields(frames, keep)}, " + "".join(f"`{n}` array<double>, " for n in out) + "out_height int, out_width int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, height, width in _of_one_shape(batches, model.pixels):
            found = np.asarray(model.ready()(_stacked(batch, planes, height, width)), dtype=float)
            if found.ndim != 4 or found.shape[:2] != (batch.num_rows, len(out)):
                raise ValueError(f"a model of {batch.num_rows} frames gave an array of shape {found.shape}")
            sides = [pa.array(np.full(batch.num_rows, n, np.int32)) for n in found.shape[2:]]
            lists = [_flat(found[:, i]) for i in range(len(out))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists, *sides], schema=pa.schema(made))

    return frames.mapInArrow(run, schema)


def model_scores(frames: DataFrame, keys: Sequence[str], scorers: dict[str, Model], one: Sequence[str], other: Sequence[str]) -> DataFrame:
    """(keys, a number per scorer) of the frames ``one`` against ``other``, a batch of one shape at a time."""
    most = min((s.pixels for s in scorers.values()), default=PIXELS)
    some = frames.select(*dict.fromkeys([*keys, "height", "width", *one, *other]))
    made = [*to_arrow_schema(frames.select(*keys).schema), *[pa.field(n, pa.float64()) for n in scorers]]
    schema = _fields(frames, keys) + "".join(f", `{n}` double" for n in scorers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, height, width in _of_one_shape(batches, most):
            sides = [_stacked(batch, names, height, width) for names in (one, other)]
            scores = [np.asarray(s.ready()(*sides), dtype=float) for s in scorers.values()]
            if any(score.shape != (batch.num_rows,) for score in scores):
                raise ValueError(f"a scorer of {batch.num_rows} frames gave shapes {[s.shape for s in scores]}")
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], *map(pa.array, scores)], schema=pa.schema(made))

    return some.mapInArrow(run, schema)
