"""PNG bytes, both ways."""

import zlib

import numpy as np
import pytest

from nitlake.sinks.png import _chunk, encode_png, frame_names, to_png, write_files
from nitlake.sources.png import SIGNATURE, as_signal, decode_png, read_frames


def test_sixteen_bits_round_trip_with_tag():
    picture = np.random.default_rng(1).integers(0, 65536, (3, 5, 7))
    back, chunks = decode_png(encode_png(picture, 16, tag_pq=True))
    assert np.array_equal(back, picture) and chunks["cICP"] == bytes([9, 16, 0, 1])
    with pytest.raises(ValueError):
        encode_png(picture[0], 16)
    with pytest.raises(ValueError):
        decode_png(b"no picture")


def filtered(picture, kind):
    """The same picture with every row under one filter."""
    rows = picture.transpose(1, 2, 0).astype("u1").reshape(picture.shape[1], -1).astype(int)
    out = []
    for y, row in enumerate(rows):
        up = rows[y - 1] if y else np.zeros_like(row)
        left = np.concatenate([np.zeros(3, int), row[:-3]])
        corner = np.concatenate([np.zeros(3, int), up[:-3]])
        near = left + up - corner
        gaps = np.abs(np.stack([near - left, near - up, near - corner]))
        paeth = np.choose(gaps.argmin(axis=0), [left, up, corner])
        guess = {0: 0, 1: left, 2: up, 3: (left + up) // 2, 4: paeth}[kind]
        out.append(np.concatenate([[kind], (row - guess) % 256]))
    header = encode_png(picture, 8)[8:33]
    body = zlib.compress(np.array(out, dtype="u1").tobytes())
    return SIGNATURE + header + _chunk(b"IDAT", body) + _chunk(b"IEND", b"")


@pytest.mark.parametrize("kind", range(5))
def test_row_filters(kind):
    picture = np.random.default_rng(kind).integers(0, 256, (3, 6, 5))
    assert np.array_equal(decode_png(filtered(picture, kind))[0], picture)


def test_frames_to_files_and_back(spark, tmp_path):
    planes = np.random.default_rng(3).integers(0, 65536, (4, 3, 12)) / 65535
    rows = [(n, 3, 4, *(p.tolist() for p in frame)) for n, frame in enumerate(planes)]
    df = spark.createDataFrame(rows, "frame int, height int, width int, r array<double>, g array<double>, b array<double>")
    written = write_files(to_png(frame_names(df), 16, True), str(tmp_path / "out")).collect()
    assert sorted(r["name"] for r in written) == [f"hdr_{n:06d}.png" for n in range(4)]
    back = as_signal(read_frames(spark, str(tmp_path / "out"), 16)).orderBy("path").collect()
    np.testing.assert_allclose([[r["r"], r["g"], r["b"]] for r in back], planes, atol=1e-12)
    with pytest.raises(Exception, match="16-bit codes, expected 8"):
        read_frames(spark, str(tmp_path / "out"), 8).collect()
