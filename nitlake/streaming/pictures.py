"""Frames written as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sinks.png import frame_names
from ..sources import pictures


def write_frames(
    frames: DataFrame, folder: str, checkpoint: str, number: str = "frame", by: str | None = None
) -> StreamingQuery:
    """A stream of HDR frames to numbered 16-bit pictures in ``folder``, below the value of ``by`` if given.

    The pictures of a micro-batch come into place together, when it is committed.
    """
    pictures.register(frames.sparkSession)
    named = frame_names(frames, number)
    if by is not None:
        named = named.withColumn("name", F.concat(F.col(by).cast("string"), F.lit("/"), F.col("name")))
    writer = named.select("name", "height", "width", "r", "g", "b").writeStream.format(pictures.FORMAT)
    writer = writer.option("checkpointLocation", checkpoint).option("path", folder)
    return writer.trigger(availableNow=True).start()
