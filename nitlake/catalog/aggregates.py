"""A user's aggregate with a merge, in batch and on a stream."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from ..functions.common import round_to
from ..operators.aggregate import aggregated, summed
from ..session import shared_dir
from ..sources import tables
from ..streaming.aggregate import aggregated_stream
from . import query
from . import sqltext as q

BINS = 4
_NAMES = ["n", "total", "gap", *(f"h{i}" for i in range(BINS))]


def _each(columns):
    """What each row adds to the sums."""
    target, prediction = columns
    ratio = np.clip((target / prediction * 2).astype(int), 0, BINS - 1)
    return np.column_stack([np.ones(len(target)), target, np.abs(target - prediction), *(ratio == i for i in range(BINS))])


def _gaps(columns):
    """Count, sum of target light, sum of the gap, and a histogram of target over prediction."""
    return _each(columns).sum(0)


def _finish(state):
    return [int(state[0]), state[1], state[2] / state[0], *(int(n) for n in state[3:])]


GAPS = summed(
    ["tr", "pr"], 3 + BINS, _gaps, _finish, "n bigint, total double, gap double, " + ", ".join(f"h{i} bigint" for i in range(BINS)), _each,
)
_BIN = f"least(floor(tr/pr*2),{BINS - 1})"
_SQL = q.rows(
    q.PX,
    select="SELECT video, variant, count(*) AS n, round(sum(tr),6) AS total, round(avg(abs(tr-pr)),6) AS gap, "
    + ", ".join(f"count(*) FILTER ({_BIN} = {i}) AS h{i}" for i in range(BINS))
    + " FROM px GROUP BY ALL",
)


def _rows(found):
    plain = [n if n not in ("total", "gap") else round_to(F.col(n), 6).alias(n) for n in _NAMES]
    return found.select("video", "variant", *plain)


@query("user_aggregate", _SQL)
def user_aggregate(spark, folder):
    """Sums, means and a histogram of light, as one aggregate with a merge."""
    return _rows(aggregated(tables.px(spark, folder), ["video", "variant"], GAPS))


@query("user_aggregate_stream", _SQL)
def user_aggregate_stream(spark, folder):
    """The same aggregate over three micro-batches."""
    place = f"{shared_dir(spark)}/aggregate-{uuid.uuid4().hex}"
    px = tables.px(spark, folder).select("video", "variant", "tr", "pr")
    # A micro-batch of one file would be work for one task.
    files = max(1, spark.sparkContext.defaultParallelism)
    px.repartition(3 * files).write.parquet(f"{place}/arrived")
    arrived = spark.readStream.schema(px.schema).option("maxFilesPerTrigger", files).parquet(f"{place}/arrived")
    stream = aggregated_stream(arrived, ["video", "variant"], GAPS)
    writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{place}/state")
    writer.trigger(availableNow=True).start(f"{place}/rows").awaitTermination()
    given = spark.read.schema(stream.schema).parquet(f"{place}/rows")
    last = given.groupBy("video", "variant").agg(F.max_by(F.struct(*_NAMES), "updates").alias("_last"))
    return _rows(last.select("video", "variant", "_last.*"))
