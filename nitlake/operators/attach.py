"""Per-group results back onto the rows they came from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

# A broadcast side has at most this many rows, and at most this many bytes written out as text.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 16_000_000


def attach(
    rows: DataFrame,
    groups: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    broadcast_rows: int = BROADCAST_ROWS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join one row per group to many rows.

    The groups are reduced once and written to the shared folder; one look at them tells how many
    there are and how large. Few groups are broadcast and the rows stay where they are; Spark's estimate
    for the result of an aggregate would have it shuffle all of them. Many groups are joined
    by key, where adaptive execution splits a group that holds most rows.
    """
    groups = cut(groups)
    text = F.to_json(F.struct(*(F.col(f"`{name}`") for name in groups.columns)))
    count, size = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    if count <= broadcast_rows and size <= broadcast_bytes:
        groups = F.broadcast(groups)
    return rows.join(groups, list(keys), how)
