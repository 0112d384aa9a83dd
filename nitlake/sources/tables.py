"""Views over the given tables that stand for frames, pixels, sequences and catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.common import rgb
from ..functions.transfer import pq_oetf_nits
from ..operators.numbering import number_rows
from ..session import spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def px(spark: SparkSession, folder: str) -> DataFrame:
    """Paired pixels in absolute light: target ``tr tg tb``, prediction ``pr pg pb``."""
    items = table(spark, folder, "lineitem").select(
        *("l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"),
        *("l_quantity", "l_discount", "l_tax"),
    )
    return spread(items).selectExpr(
        "l_suppkey AS video",
        "l_linenumber AS frame",
        "l_returnflag AS variant",
        "CASE WHEN l_linestatus = 'O' THEN 'expert' ELSE 'synthetic' END AS track",
        "l_quantity * 20D AS tr",
        "l_discount * 10000D AS tg",
        "l_tax * 12500D AS tb",
        "l_quantity * 16D + 5 AS pr",
        "l_discount * 8000D + 5 AS pg",
        "l_tax * 10000D + 5 AS pb",
    )


def coded(pixels: DataFrame) -> DataFrame:
    """The pixel view with PQ codes in place of light."""
    codes = {}
    for side in "tp":
        for channel, code in zip("rgb", rgb(side).map(pq_oetf_nits)):
            codes[side + channel] = code
    return pixels.withColumns(codes)


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """One 8x8 plane of codes per row of ``embeddings``."""
    return planes_of(spread(table(spark, folder, "embeddings")))


def planes_of(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(
        F.floor(F.col("vec_id") / 10).cast("bigint").alias("video"),
        (F.col("vec_id") % 10).alias("frame"),
        F.lit(8).alias("height"),
        F.lit(8).alias("width"),
        F.transform(
            "embedding",
            lambda e: F.least(F.greatest(e.cast("double") + F.lit(0.5), F.lit(0.0)), F.lit(1.0)),
        ).alias("plane"),
        "label",
    )


def signal(spark: SparkSession, folder: str) -> DataFrame:
    """One-value frames of long sequences, not yet numbered."""
    return signal_of(table(spark, folder, "events"))


def signal_of(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "user_id AS video",
        "event_id AS ordinal",
        "CAST(ts AS TIMESTAMP) AS ts",
        "event_type AS variant",
        "value * 2D AS nits",
    )


def numbered_signal(spark: SparkSession, folder: str) -> DataFrame:
    """:func:`signal` with ``frame`` = 0, 1, ... per video by time."""
    return number_rows(
        signal(spark, folder), ["ts", "ordinal"], ["video"], [F.to_date("ts")], out="frame"
    )


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """A catalogue of videos; only names and sizes are read, never texts."""
    return corpus_of(table(spark, folder, "documents"))


def corpus_of(documents: DataFrame) -> DataFrame:
    return documents.selectExpr(
        "doc_id",
        "source AS source_dataset",
        "lang AS category",
        "substring(sha2(concat(source, ':', CAST(doc_id AS STRING)), 256), 1, 32) AS video",
        "n_chars AS bytes",
    )


def turns(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").selectExpr(
        "conv_id AS video", "turn AS frame", "role", "text"
    )


def features(spark: SparkSession, folder: str) -> DataFrame:
    """Two 32-number scales per row."""
    return spread(table(spark, folder, "embeddings")).selectExpr(
        "vec_id",
        "label",
        "transform(slice(embedding, 1, 32), e -> CAST(e AS DOUBLE)) AS s1",
        "transform(slice(embedding, 33, 32), e -> CAST(e AS DOUBLE)) AS s2",
    )
