"""Many texts at once as NumPy arrays: their bytes, words, lines and rolling hashes.

Helpers for functions that Spark runs over Arrow batches. Everything works on the bytes of a
block of texts laid end to end, so that the cost per byte is a few vector operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on together. Only memory and speed depend on it.
BLOCK = 2_000_000

_ODD = 0x9E3779B97F4A7C15
# The multipliers of the public 64-bit finaliser of MurmurHash3.
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``x`` (64-bit unsigned)."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x ^= x >> np.uint64(33)
    x *= _M2
    x ^= x >> np.uint64(33)
    return x


def _table(seed: int) -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD) + np.uint64(seed))


class Rolling:
    """Hashes of any byte span of a block by two reads: polynomials modulo 2^64."""

    def __init__(self, data: np.ndarray, seed: int = 1):
        base = 0xD6E8FEB86659FD93 + 2 * seed  # odd, so that it has an inverse modulo 2^64
        n = len(data) + 1
        self.inverse = _powers(pow(base, -1, 1 << 64), n)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(_table(seed)[data] * _powers(base, n)[:-1], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Equal spans have equal hashes; the length goes in too."""
        found = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mixed(found + (end - start).astype(np.uint64) * np.uint64(_ODD))

    def every(self, k: int) -> np.ndarray:
        """Hashes of all spans of ``k`` bytes, by start."""
        return mixed((self.sums[k:] - self.sums[:-k]) * self.inverse[: len(self.sums) - k] + np.uint64(k * _ODD % (1 << 64)))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base^0, base^1, ... modulo 2^64; kept, as every block asks for the same."""
    if len(_POWERS.get(base, ())) < n:
        made = np.full(n + n // 4, base, np.uint64)  # as the next block may be somewhat larger
        made[0] = 1
        _POWERS[base] = np.cumprod(made)
    return _POWERS[base][:n]


class Block:
    """Texts laid end to end: ``data`` (bytes), and where text i begins and ends."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, rows: slice):
        self.data, self.offsets, self.rows = data, offsets, rows
        self.start, self.end = offsets[:-1], offsets[1:]
        self.texts = len(offsets) - 1

    def owner(self, at: np.ndarray) -> np.ndarray:
        """The text that each byte position lies in."""
        return np.searchsorted(self.offsets, at, side="right") - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, text) of all runs of other bytes than the six white ones; runs end with their text."""
        inside = np.zeros(len(self.data) + 2, bool)
        np.logical_not(SPACE[self.data], out=inside[1:-1])
        starts = np.flatnonzero(inside[1:] & ~inside[:-1])
        ends = np.flatnonzero(~inside[1:] & inside[:-1])
        cuts = self.offsets[1:-1]
        cuts = np.unique(cuts[inside[cuts] & inside[cuts + 1]]) if len(cuts) else cuts
        if len(cuts):  # a word that would run on into the next text
            starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
        return starts, ends, self.owner(starts)


def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column laid end to end, and the offsets; null is empty."""
    held = batch.column(name)
    if held.null_count:
        held = held.fill_null("" if pa.types.is_string(held.type) or pa.types.is_large_string(held.type) else b"")
    wide = pa.types.is_large_string(held.type) or pa.types.is_large_binary(held.type)
    _, offsets, data = held.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[held.offset : held.offset + len(held) + 1]
    offsets = offsets.astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(data: np.ndarray, offsets: np.ndarray, size: int = BLOCK) -> Iterator[Block]:
    """Blocks of whole texts of about ``size`` bytes, or of one text where it is longer."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        to = int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1
        to = min(max(to, row + 1), rows)
        yield Block(data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row], slice(row, to))
        row = to


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each length, laid end to end."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
