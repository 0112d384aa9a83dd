"""Models and scorers that run on batches of frames of one shape."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.common import round_to
from ..operators import models
from ..sources import tables
from . import query
from . import sqltext as q
from .frames import KEYS

_CHANNELS = {"r": "code", "g": "code*5e-1", "b": "1e0-code"}
# Frames of two shapes: those of odd number are the upper half.
_SHAPED = "shaped AS (SELECT * FROM planes WHERE frame % 2 = 0 OR y < 4)"


def _frames(spark, folder):
    df = tables.frames(spark, folder)
    odd = F.col("frame") % 2 == 1
    plane = F.when(odd, F.slice("plane", 1, 32)).otherwise(F.col("plane"))
    df = df.withColumns({"plane": plane, "height": F.when(odd, F.lit(4)).otherwise(F.lit(8))})
    return df.select(
        *KEYS, "height", "width", F.col("plane").alias("r"),
        F.transform("plane", lambda c: c * 0.5).alias("g"), F.transform("plane", lambda c: 1 - c).alias("b"),
    )


def _expand():
    """The inverse of x / (1 + x), on codes that are kept below its pole."""
    return lambda frames: 0.9 * frames / (1 - 0.9 * frames)


def _gap():
    return lambda one, other: np.abs(one - other).mean(axis=(1, 2, 3))


def _most():
    return lambda one, other: np.abs(one - other).max(axis=(1, 2, 3))


_LIGHT = {c: f"9e-1*({v})/(1e0-9e-1*({v}))" for c, v in _CHANNELS.items()}


@query(
    "model_frames",
    q.rows(
        q.PLANES, _SHAPED,
        select="SELECT video, frame, y::BIGINT AS y, x::BIGINT AS x, "
        + ", ".join(f"round({v},8) AS {c}" for c, v in _LIGHT.items())
        + " FROM shaped",
    ),
)
def model_frames(spark, folder):
    """An analytic inverse as the model, on frames of two shapes."""
    lit = models.model_frames(_frames(spark, folder), models.Model(_expand, 2000), list("rgb"), ["pr", "pg", "pb"])
    zipped = F.arrays_zip("pr", "pg", "pb")
    spread = lit.select(*KEYS, F.col("out_width").alias("_w"), F.posexplode(zipped).alias("i", "p"))
    return spread.select(
        *KEYS,
        F.floor(F.col("i") / F.col("_w")).alias("y"),
        (F.col("i") % F.col("_w")).cast("bigint").alias("x"),
        *(round_to(F.col(f"p.p{c}"), 8).alias(c) for c in "rgb"),
    )


_GAPS = " UNION ALL ".join(f"SELECT video, frame, abs({_LIGHT[c]}-({v})) AS gap FROM shaped" for c, v in _CHANNELS.items())


@query(
    "model_scores",
    q.rows(
        q.PLANES, _SHAPED, f"gaps AS ({_GAPS})",
        select="SELECT video, frame, round(avg(gap),8) AS gap, round(max(gap),8) AS most FROM gaps GROUP BY ALL",
    ),
)
def model_scores(spark, folder):
    """Two scorers on what the model made and what it was given."""
    lit = models.model_frames(_frames(spark, folder), models.Model(_expand), list("rgb"), ["pr", "pg", "pb"])
    scorers = {"gap": models.Model(_gap), "most": models.Model(_most)}
    scores = models.model_scores(lit, KEYS, scorers, ["pr", "pg", "pb"], list("rgb"))
    return scores.select(*KEYS, *(round_to(F.col(n), 8).alias(n) for n in scorers))
