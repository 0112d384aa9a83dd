"""Small Column helpers shared by the colour functions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class RGB(NamedTuple):
    """Three channel columns."""

    r: Column
    g: Column
    b: Column

    def map(self, fn) -> "RGB":
        return RGB(fn(self.r), fn(self.g), fn(self.b))


def num(value: float) -> Column:
    return F.lit(float(value))


def at_least(x: Column, low: float) -> Column:
    return F.greatest(x, num(low))


def at_most(x: Column, high: float) -> Column:
    return F.least(x, num(high))


def clamp(x: Column, low: float, high: float) -> Column:
    return at_most(at_least(x, low), high)


def rgb(prefix: str) -> RGB:
    """Columns ``<prefix>r``, ``<prefix>g``, ``<prefix>b``."""
    return RGB(F.col(prefix + "r"), F.col(prefix + "g"), F.col(prefix + "b"))


def lay(df: DataFrame, prefix: str, colour: RGB) -> tuple[DataFrame, RGB]:
    """Put a colour into three named columns so that later steps refer to it by name.

    Long colour chains are laid out step by step: each step is a projection in the
    same code-generation span, and nothing is written out twice in the plan.
    """
    names = [prefix + channel for channel in "rgb"]
    return df.withColumns(dict(zip(names, colour))), RGB(*(F.col(name) for name in names))


def round_to(x: Column, digits: int = 6) -> Column:
    return F.round(x, digits)
