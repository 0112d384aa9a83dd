"""Session settings and the one place that decides where checkpoints go."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The JVM never compiles a method of more than 8,000 bytes of code. Long colour chains
    # would be interpreted; beyond this limit Spark splits them into small methods instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # A top-k of up to this many rows per group is cut before the shuffle.
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
    # Up to this many named keys reach a Parquet scan one by one, and not as the range they span.
    "spark.sql.parquet.pushdown.inFilterThreshold": "200",
    # Rows with a text or a picture each go to Python in batches of a few megabytes.
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


def session(app: str = "nitlake", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or fetch) a session with the settings the operators expect."""
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and cut-point tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session, where one
    machine is the whole cluster, may fall back to a temporary folder.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = os.environ.get("NITLAKE_LOCAL_CHECKPOINTS") or tempfile.mkdtemp(prefix="nitlake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


#: Whether Spark removes what a query shuffled as soon as the query ends.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

TUNING = (
    "spark.sql.codegen.hugeMethodLimit",
    "spark.sql.optimizer.windowGroupLimitThreshold",
    "spark.sql.parquet.pushdown.inFilterThreshold",
    "spark.sql.execution.arrow.maxBytesPerBatch",
)


def prepare(spark: SparkSession) -> None:
    """Ready a session that :func:`session` did not build."""
    for key in TUNING:
        spark.conf.set(key, SETTINGS[key])
    ship(spark)


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of a session that did not install it."""
    context = spark.sparkContext
    if getattr(context, "_nitlake_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="nitlake-ship-"), "nitlake")
    made = shutil.make_archive(archive, "zip", os.path.dirname(package), "nitlake")
    context.addPyFile(made)
    context._nitlake_shipped = True


def spread(df: DataFrame) -> DataFrame:
    """Rows on every core where the input has fewer splits than the cluster has cores.

    A small file is one split, and pixel work on it would leave all cores but one idle.
    Input that is large for the cluster has more splits than cores and is left as it lies.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back.

    For what is costly to make and read more than once: later passes read only the columns
    they need, and never decode or predict again.
    """
    place = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(FREED)
    conf.set(FREED, "true")  # else what was shuffled stays on disk until the driver collects garbage
    try:
        df.write.parquet(place)
    finally:
        conf.set(FREED, before)
    table = df.sparkSession.read.parquet(place)
    table._nitlake_place = place
    return table


def discard(*tables: DataFrame) -> None:
    """Remove what :func:`stored` wrote, once all that reads it has been written itself."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._nitlake_place)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def by_key(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join by key, never broadcast.

    For what grows with the corpus. Spark takes a stored table to be as large as its compressed files, and
    what an explode makes as large as what went in, so that a broadcast could be many times its limit.
    """
    return df.hint("merge")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written copy.

    Used where two readers must see exactly the same rows in the same partitions
    even if an executor is lost between them.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
