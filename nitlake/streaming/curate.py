"""Curation of arriving frames: each is worked on once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def curate_stream(
    frames: DataFrame,
    records: Callable[[DataFrame], DataFrame],
    folder: str,
    checkpoint: str,
) -> StreamingQuery:
    """Append the records of frames that the manifest in ``folder`` does not have yet.

    ``frames`` is a stream with ``video`` and ``frame``; ``records`` turns a batch of new frames
    into manifest records. Frames of a video may arrive in several micro-batches and more than
    once; each is worked on once. What a micro-batch adds lies in a folder named by the run of
    its checkpoint and its number: one that is run again after a failure replaces its own rows,
    and no run ever touches another's. A micro-batch reads the names of the videos it has only,
    as names are stored by a bucket of the video.
    """
    names = f"{folder}-names"

    def work(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # The id belongs to the checkpoint, so a restarted query goes on in its own folders.
        place = f"run={_run_id(spark)}/batch={number}"
        arrived = batch.dropDuplicates(["video", "frame"])
        arrived = arrived.withColumn("_bucket", F.pmod(F.xxhash64("video"), F.lit(BUCKETS)))
        done = _names(spark, names, place)
        if done is not None:
            touched = [r["_bucket"] for r in arrived.select("_bucket").distinct().collect()]
            done = done.where(F.col("_bucket").isin(touched)).select("_bucket", "video", "frame")
            arrived = arrived.join(done, ["_bucket", "video", "frame"], "left_anti")
        arrived = arrived.persist()
        records(arrived.drop("_bucket")).write.mode("overwrite").parquet(f"{folder}/{place}")
        kept = arrived.select("_bucket", "video", "frame")
        kept.write.mode("overwrite").partitionBy("_bucket").parquet(f"{names}/{place}")
        arrived.unpersist()

    writer = frames.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


#: Buckets of the stored names; a micro-batch touches at most that many.
BUCKETS = 64


def _run_id(spark: SparkSession) -> str:
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId")


def _names(spark: SparkSession, names: str, place: str) -> DataFrame | None:
    """Names that other micro-batches have stored, of whichever run."""
    try:
        found = spark.read.parquet(names)
    except AnalysisException as problem:
        if problem.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    run, batch = (part.split("=")[1] for part in place.split("/"))
    return found.where((F.col("run").cast("string") != run) | (F.col("batch") < int(batch)))
