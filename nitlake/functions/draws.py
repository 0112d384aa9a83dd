"""Stateless random numbers: a keyed hash of the row, the same on every retry."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# A ticket is a whole number below this.
TICKETS = 2**48


def ticket(seed: int | str, *parts: Column) -> Column:
    text = F.concat_ws(":", F.lit(str(seed)), *(part.cast("string") for part in parts))
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("bigint")


def uniform(drawn: Column) -> Column:
    """A ticket as a number in [0, 1)."""
    return drawn / F.lit(float(TICKETS))


def below(drawn: Column, limit: Column) -> Column:
    """A ticket as a whole number in [0, limit)."""
    return drawn % limit


def normal(one: Column, other: Column) -> Column:
    """Box-Muller on two tickets."""
    radius = F.sqrt(F.lit(-2.0) * F.log((one + F.lit(1)) / F.lit(float(TICKETS))))
    return radius * F.cos(F.lit(2 * math.pi) * uniform(other))
