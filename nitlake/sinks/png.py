"""Frame rows as PNG bytes and files."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import HDR_CODES, SDR_CODES
from ..functions.labels import padded
from ..sources.png import SIGNATURE, opened

# Colour tag for PQ, BT.2020, RGB, full range.
PQ_TAG = bytes([9, 16, 0, 1])


def _chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def encode_png(picture: np.ndarray, depth: int, tag_pq: bool = False, level: int = 6) -> bytes:
    """A (3, h, w) array of integer codes as an RGB PNG, rows unfiltered."""
    if picture.ndim != 3 or picture.shape[0] != 3:
        raise ValueError(f"expected (3, h, w), got {picture.shape}")
    _, height, width = picture.shape
    codes = picture.transpose(1, 2, 0).astype(">u2" if depth == 16 else "u1")
    lines = np.frombuffer(codes.tobytes(), np.uint8).reshape(height, -1)
    raw = np.pad(lines, ((0, 0), (1, 0))).tobytes()
    header = struct.pack(">IIBBBBB", width, height, depth, 2, 0, 0, 0)
    parts = [SIGNATURE, _chunk(b"IHDR", header)]
    if tag_pq:
        parts.append(_chunk(b"cICP", PQ_TAG))
    return b"".join([*parts, _chunk(b"IDAT", zlib.compress(raw, level)), _chunk(b"IEND", b"")])


def to_png(frames: DataFrame, depth: int, tag_pq: bool = False, name: str = "name") -> DataFrame:
    """Rows ``name, png`` from signals ``r g b`` in [0, 1] with ``height`` and ``width``."""
    top = HDR_CODES if depth == 16 else SDR_CODES
    slim = frames.select(name, "height", "width", "r", "g", "b")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pictures = []
            for row in batch.itertuples(index=False):
                planes = np.stack([np.asarray(p, float) for p in (row.r, row.g, row.b)])
                codes = np.rint(np.clip(planes, 0, 1) * top)
                pictures.append(
                    encode_png(codes.reshape(3, row.height, row.width), depth, tag_pq)
                )
            yield pd.DataFrame({name: batch[name], "png": pictures})

    return slim.mapInPandas(encode, f"{name} string, png binary")


def write_files(pictures: DataFrame, folder: str, name: str = "name") -> DataFrame:
    """Write every picture as its own file, from the tasks; returns names and sizes.

    ``folder`` is a path or URI that every executor can reach. A file is written beside its
    place and moved there, so a task that runs twice leaves one whole file.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        system, root = opened(folder)
        made = set()
        for batch in batches:
            for file_name, data in zip(batch[name], batch["png"]):
                target = f"{root.rstrip('/')}/{file_name}"
                place = target.rpartition("/")[0]
                if place not in made:
                    system.create_dir(place, recursive=True)
                    made.add(place)
                partial = f"{target}.{uuid.uuid4().hex}"
                with system.open_output_stream(partial) as handle:
                    handle.write(data)
                system.move(partial, target)
            yield pd.DataFrame({name: batch[name], "bytes": [len(d) for d in batch["png"]]})

    return pictures.mapInPandas(write, f"{name} string, bytes bigint")


def frame_names(frames: DataFrame, number: str = "frame") -> DataFrame:
    """Names ``hdr_000000.png``, ``hdr_000001.png``, ... for a numbered sequence."""
    return frames.withColumn("name", F.concat(F.lit("hdr_"), padded(F.col(number), 6), F.lit(".png")))
