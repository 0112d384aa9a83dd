"""Stored predictions as frame rows to be scored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import PREDICTIONS
from ..session import stored
from . import manifest, png


def load_predictions(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """Frame rows for :func:`nitlake.plans.evaluate.evaluate` from a prediction manifest.

    ``path`` is the manifest, ``folder`` what its ``prediction`` and ``reference`` paths are
    relative to. Records get their place as ``ordinal``. Both pictures of a record are read
    by the task that holds the record, so no picture is shuffled to meet the other; the
    decoded codes are stored, because scoring passes over them several times.
    """
    records = manifest.read_manifest(spark, path, PREDICTIONS, ordinal="ordinal")
    root = F.lit(folder.rstrip("/") + "/")
    files = {"_p": F.concat(root, "prediction"), "_t": F.concat(root, "reference")}
    decoded = png.decode_named(records.withColumns(files), {"p": "_p", "t": "_t"})
    pictures = stored(decoded, "predictions")

    def signal(side: str):
        top = F.when(F.col(f"{side}depth") == 16, F.lit(65535.0)).otherwise(F.lit(255.0))
        return {side + c: F.transform(side + c, lambda v: v / top) for c in "rgb"}

    scaled = pictures.withColumns({**signal("p"), **signal("t")})
    sized = scaled.withColumnsRenamed(
        {"theight": "height", "twidth": "width", "pheight": "p_height", "pwidth": "p_width"}
    )
    return sized.drop("_p", "_t", "pdepth", "tdepth")
