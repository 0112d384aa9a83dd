"""Smoothing of arriving tone parameters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .order import in_order

APPLIED = "ordinal bigint, applied array<double>"


def smoothed(params: DataFrame, alpha: float, late: str = "1 minute", quiet_ms: int | None = None) -> DataFrame:
    """A stream of applied parameters; what a video carries on is what was applied last.

    ``params`` is a stream of ``video, ts, ordinal, params``. Rows may come ``late`` behind newer ones and
    in any order within that; they are smoothed in the order of ``(ts, ordinal)``. See :func:`in_order`.
    """
    if not 0.0 <= alpha < 1.0:
        raise ValueError("alpha must lie in [0, 1)")

    def advance(key: tuple, before: tuple | None, rows: list[tuple]) -> tuple[dict[str, list], tuple]:
        block = np.array([np.frombuffer(row[1]) for row in rows])
        last, start = (block[0].copy(), 1) if before is None else (np.frombuffer(before[0]), 0)
        for row in block[start:]:  # in place: row by row, all parameters of a row at once
            row *= 1 - alpha
            row += alpha * last
            last = row
        return {"ordinal": [row[0] for row in rows], "applied": list(block)}, (block[-1],)

    slim = params.select("video", "ts", "ordinal", "params")
    return in_order(slim, ["video"], "ts", ["ordinal"], advance, APPLIED, late, quiet_ms)
