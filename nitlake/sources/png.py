"""PNG pictures as frame rows."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels
from .files import list_files

# The signature and the samples per pixel of each colour type read here.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 4: 2, 6: 4}

PICTURES_PER_TASK = 1_000
PICTURES_AT_ONCE = 8


def _unfilter(rows: np.ndarray, step: int) -> np.ndarray:
    """Undo the row filters; ``rows`` has the filter type in front of every row."""
    kinds, lines = rows[:, 0], rows[:, 1:]
    if kinds.max(initial=0) > 4:
        raise ValueError(f"unknown PNG row filter {kinds.max()}")
    if (kinds > 2).any():
        return _by_diagonals(kinds, lines.reshape(len(rows), -1, step)).reshape(lines.shape)
    done = np.zeros((len(rows) + 1, lines.shape[1]), np.uint8)
    for y, (kind, line) in enumerate(zip(kinds, lines)):
        if kind == 1:
            line = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        done[y + 1] = line + done[y] if kind == 2 else line
    return done[1:]


def _by_diagonals(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """All five filters undone at once. A pixel needs the ones to its left, above, and above the
    left one, so all pixels of an anti-diagonal (one of each row) are free at the same time."""
    height, width, step = lines.shape
    out = np.empty_like(lines)
    # Row y of the last two diagonals is at y + 1; what lies outside the picture is zero.
    last, before = np.zeros((2, height + 1, step), np.int16)
    for d in range(width + height - 1):
        ys = np.arange(max(0, d - width + 1), min(height - 1, d) + 1)
        left, above, corner = last[ys + 1], last[ys], before[ys]
        da, db, dc = np.abs(above - corner), np.abs(left - corner), np.abs(left + above - 2 * corner)
        nearest = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, above, corner))
        guess = np.choose(kinds[ys, None], (np.zeros_like(left), left, above, (left + above) >> 1, nearest))
        value = (lines[ys, d - ys] + guess) & 255
        out[ys, d - ys] = value
        before, last = last, before
        last[:] = before
        last[ys + 1] = value
    return out


def decode_png(data: bytes) -> tuple[np.ndarray, dict[str, bytes]]:
    """A (3, h, w) array of integer codes, gray repeated, and the other chunks by name."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    place, packed, chunks = 8, [], {}
    while place + 8 <= len(data):
        (length,) = struct.unpack_from(">I", data, place)
        name = data[place + 4 : place + 8].decode("latin1")
        body = data[place + 8 : place + 8 + length]
        place += 12 + length
        if name == "IDAT":
            packed.append(body)
        elif name == "IEND":
            break
        else:
            chunks[name] = body
    width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", chunks["IHDR"])
    if depth not in (8, 16) or colour not in SAMPLES or interlace:
        raise ValueError("only plain 8-bit and 16-bit gray or RGB PNGs are read")
    step = SAMPLES[colour] * depth // 8
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    lines = _unfilter(raw.reshape(height, 1 + width * step), step)
    samples = np.ascontiguousarray(lines).view(">u2" if depth == 16 else "u1")
    picture = samples.reshape(height, width, SAMPLES[colour]).astype(np.int32)
    if SAMPLES[colour] < 3:
        picture = np.repeat(picture[..., :1], 3, axis=2)
    return picture[..., :3].transpose(2, 0, 1), chunks


def opened(path: str):
    """The file system and the name in it of a local path or of any URI that Arrow knows."""
    from urllib.parse import quote

    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(quote(path, safe=":/@?&="))
    return fs.LocalFileSystem(), path


def read_bytes(path: str) -> bytes:
    """One file, by local path or URI."""
    system, name = opened(path)
    with system.open_input_stream(name) as stream:
        return stream.read()


def decode_named(names: DataFrame, columns: Mapping[str, str], depth: int | None = None):
    """Decode the pictures that the rows of a table name, in the tasks that go on with them.

    For each prefix in ``columns`` the picture named by that column is added as integer
    planes ``<prefix>r/g/b`` with ``<prefix>height``, ``width`` and ``depth``. Only names are
    moved to spread the work; no picture is read that no row names. ``depth`` rejects
    pictures of another bit depth.
    """
    cores = names.sparkSession.sparkContext.defaultParallelism
    tasks = max(cores, -(-names.count() // PICTURES_PER_TASK))
    types = dict(names.dtypes)
    schema = ", ".join(f"{name} {kind}" for name, kind in types.items())
    for prefix in columns:
        schema += "".join(f", {prefix}{n} int" for n in ("height", "width", "depth"))
        schema += "".join(f", {prefix}{c} array<int>" for c in "rgb")

    def one(row: dict) -> dict:
        for prefix, column in columns.items():
            picture, chunks = decode_png(read_bytes(row[column]))
            found = chunks["IHDR"][8]
            if depth is not None and found != depth:
                raise ValueError(f"{row[column]} has {found}-bit codes, expected {depth}")
            _, height, width = picture.shape
            row |= {f"{prefix}height": height, f"{prefix}width": width, f"{prefix}depth": found}
            row |= {f"{prefix}{c}": plane.ravel() for c, plane in zip("rgb", picture)}
        return row

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), PICTURES_AT_ONCE):
                rows = batch.iloc[start : start + PICTURES_AT_ONCE].to_dict("records")
                yield pd.DataFrame([one(row) for row in rows])

    return names.repartition(tasks).mapInPandas(decode, schema)


def read_frames(spark: SparkSession, folder: str, depth: int | None = None) -> DataFrame:
    """The PNG pictures below a folder as rows of integer planes, code values unchanged."""
    found = list_files(spark, folder).where(labels.suffix(F.col("path")) == ".png")
    return decode_named(found.select("path"), {"": "path"}, depth)


def as_signal(frames: DataFrame) -> DataFrame:
    """Integer planes to signals in [0, 1] by the depth of each picture."""
    top = F.when(F.col("depth") == 16, F.lit(65535.0)).otherwise(F.lit(255.0))
    return frames.withColumns({c: F.transform(F.col(c), lambda v: v / top) for c in "rgb"})
