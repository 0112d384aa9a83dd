"""Streams run to their end over the tables, beside the SQL of their batch form."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.common import num, round_to
from ..functions.spaces import pu21_encode
from ..functions.transfer import pq_eotf_nits
from ..operators import flicker as flick
from ..operators import pair
from ..operators.metrics import TEMPORAL_METRICS
from ..session import shared_dir
from ..sources import pictures, tables
from ..streaming import curate as stream_curate
from ..streaming import ema as stream_ema
from ..streaming import flicker as stream_flicker
from ..streaming import pictures as stream_pictures
from . import query
from . import sqltext as q
from .curation import _GRID
from .evaluation import _FLICKER, _FLICKER_SELECT
from .frames import _codes
from .sampling import EMA_SQL


def _stream(spark, folder, name):
    """One table as a file stream, be the table one file or a folder of files."""
    schema = tables.table(spark, folder, name).schema
    # A stream takes a plain path for a folder. A pattern (here of the one name) may fit a file, too.
    # Files are in no order of time, so what is there is one micro-batch, sorted by its keys.
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")


def _place(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


PARTS = 2


def _late_by_a_part(rows, mark, place, made):
    """Run ``made`` (a stream and a lateness to a stream) over ``rows`` that arrive out of order.

    Time is cut into PARTS spans; a row arrives with its own span or, as its hash has it, with the next.
    Each arrival is one micro-batch of a query that is started again on its checkpoint. The last one
    brings ``mark`` alone, newer than all: it takes the watermark past what still waits.
    """
    spark = rows.sparkSession
    micros = F.unix_micros("ts")
    low, high = rows.agg(F.min(micros), F.max(micros)).first()
    width = (high - low) // PARTS + 1
    late = F.pmod(F.xxhash64("ts", "video"), F.lit(2))
    dealt = rows.withColumn("part", F.floor((micros - low) / width) + late).persist()
    newest = mark.withColumn("ts", F.timestamp_micros(F.lit(high + 10 * width)))
    for part in range(PARTS + 2):
        arrived = dealt.where(F.col("part") == part).drop("part") if part <= PARTS else newest
        arrived.select(rows.columns).write.mode("append").parquet(f"{place}/arrived")
        stream = made(spark.readStream.schema(rows.schema).parquet(f"{place}/arrived"), f"{width // 1000 + 1000} milliseconds")
        writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{place}/state")
        writer.trigger(availableNow=True).start(f"{place}/rows").awaitTermination()
    dealt.unpersist()
    return spark.read.schema(stream.schema).parquet(f"{place}/rows")


@query("flicker_stream", q.rows(*_FLICKER, select=_FLICKER_SELECT))
def flicker_stream(spark, folder):
    """Frames of all videos arrive out of order and in several micro-batches."""
    planes = tables.planes_of(tables.table(spark, folder, "embeddings"))
    units = lambda code: pu21_encode(pq_eotf_nits(code))
    frames = planes.select(
        "video",
        F.lit("dimmed").alias("variant"),
        F.timestamp_seconds(F.col("frame") + 86_400).alias("ts"),
        "frame",
        F.transform("plane", lambda c: units(c * num(0.9) + num(0.02))).alias("pred"),
        F.transform("plane", units).alias("target"),
    )
    mark = spark.range(1).select(
        F.lit(-1).cast(frames.schema["video"].dataType).alias("video"), F.lit("mark").alias("variant"),
        F.lit(-1).cast(frames.schema["frame"].dataType).alias("frame"), F.array(F.lit(0.0)).alias("pred"), F.array(F.lit(0.0)).alias("target"),
    )
    steps = _late_by_a_part(
        frames, mark, _place(spark, "flicker"), lambda arrived, late: stream_flicker.flicker_steps(flick.tiles(arrived, size=32), late)
    )
    found = flick.flicker(stream_flicker.frame_steps(steps), ["video"])
    return found.select(
        "video", *(round_to(F.col(n), 5).alias(n) for n in TEMPORAL_METRICS), "temporal"
    )


@query(
    "tone_ema_stream",
    "SELECT s.video, s.ordinal, e.applied FROM (" + EMA_SQL + ") e JOIN (WITH "
    + q.SIG
    + " SELECT video, frame, ordinal FROM sig) s USING (video, frame)",
)
def tone_ema_stream(spark, folder):
    """Parameters of all videos arrive out of order and in several micro-batches."""
    events = tables.signal_of(tables.table(spark, folder, "events"))
    params = events.select("video", "ts", "ordinal", F.array("nits").alias("params"))
    mark = spark.range(1).select(
        F.lit(-1).cast(params.schema["video"].dataType).alias("video"),
        F.lit(-1).cast(params.schema["ordinal"].dataType).alias("ordinal"), F.array(F.lit(0.0)).alias("params"),
    )
    stored = _late_by_a_part(params, mark, _place(spark, "ema"), lambda arrived, late: stream_ema.smoothed(arrived, 0.8, late))
    return stored.select("video", "ordinal", round_to(F.get("applied", F.lit(0)), 5).alias("applied"))


@query(
    "curate_stream",
    q.rows(
        q.CORPUS,
        "recs AS (SELECT video, (doc_id % 100)::INTEGER AS frame, 'train' AS split, source_dataset FROM corpus)",
        _GRID,
        select="SELECT video, frame, tmo, crf, sdr_key FROM grid",
    ),
)
def curate_stream(spark, folder):
    """The catalogue arrives as a stream, twice; the second time nothing is new."""
    place = _place(spark, "curate")

    def run():
        videos = tables.corpus_of(_stream(spark, folder, "documents")).select(
            "video",
            (F.col("doc_id") % 100).cast("int").alias("frame"),
            F.lit("train").alias("split"),
            "source_dataset",
        )
        both = videos.unionByName(videos)
        stream_curate.curate_stream(
            both, pair.degrade_grid, f"{place}/manifest", f"{place}/state"
        ).awaitTermination()

    run()
    run()
    stored = spark.read.parquet(f"{place}/manifest")
    return stored.select("video", "frame", "tmo", "crf", "sdr_key")


@query(
    "curate_stream_turns",
    q.rows(
        "recs AS (SELECT DISTINCT conv_id::VARCHAR AS video, turn::INTEGER AS frame, 'train' AS split,"
        " 'turns' AS source_dataset FROM conversations)",
        _GRID,
        select="SELECT video, frame, tmo, crf, sdr_key FROM grid",
    ),
)
def curate_stream_turns(spark, folder):
    """Several frames per video, in arbitrary order and twice, on two checkpoints into one manifest."""
    place = _place(spark, "curate")
    for state in ("one", "two"):
        turns = _stream(spark, folder, "conversations").select(
            F.col("conv_id").cast("string").alias("video"),
            F.col("turn").cast("int").alias("frame"),
            F.lit("train").alias("split"),
            F.lit("turns").alias("source_dataset"),
        )
        stream_curate.curate_stream(
            turns.unionByName(turns), pair.degrade_grid, f"{place}/manifest", f"{place}/{state}"
        ).awaitTermination()
    stored = spark.read.parquet(f"{place}/manifest")
    return stored.select("video", "frame", "tmo", "crf", "sdr_key")


@query(
    "picture_stream",
    q.rows(
        q.PLANES,
        select="SELECT video, frame, y::BIGINT AS y, x::BIGINT AS x, round_even(code*65535e0, 0)::BIGINT AS r,"
        " round_even((1e0-code)*65535e0, 0)::BIGINT AS g, '09100001' AS tag FROM planes",
    ),
)
def picture_stream(spark, folder):
    """Frames arrive as a stream and leave as numbered, tagged pictures of each video."""
    place = _place(spark, "written")
    planes = tables.planes_of(_stream(spark, folder, "embeddings"))
    frames = planes.withColumns({"r": F.col("plane"), "g": F.transform("plane", lambda v: 1 - v), "b": F.col("plane")})
    stream_pictures.write_frames(frames, f"{place}/pictures", f"{place}/state", by="video").awaitTermination()
    found = _codes(spark.read.format(pictures.FORMAT).load(f"{place}/pictures"))
    named = F.regexp_extract("path", r"([^/]+)/hdr_([0-9]+)[.]png$", 1), F.regexp_extract("path", r"hdr_([0-9]+)[.]png$", 1)
    return found.select(
        named[0].cast("bigint").alias("video"), named[1].cast("bigint").alias("frame"), "y", "x", "r", "g", "tag"
    )
