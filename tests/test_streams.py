"""Streams in several micro-batches against their batch forms."""

import duckdb
import numpy as np
import pytest
from check import compare
from pyspark.sql import functions as F
from samples import FOLDER

from nitlake import catalog
from nitlake.operators import flicker as flick
from nitlake.operators.aggregate import summed
from nitlake.operators.scan import smooth
from nitlake.streaming import aggregate as stream_aggregate
from nitlake.streaming import order
from nitlake.streaming.curate import curate_stream
from nitlake.streaming.ema import smoothed
from nitlake.operators.flicker import tiles
from nitlake.streaming.flicker import flicker_steps, frame_steps
from nitlake.streaming.pictures import write_frames


def run(stream, place):
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{place}/state")
    query = query.trigger(availableNow=True).start(f"{place}/rows")
    assert query.awaitTermination(120)
    return stream.sparkSession.read.parquet(f"{place}/rows")


def arriving(spark, df, folder, parts):
    """``df`` cut into files by ``_part`` and streamed one file at a time."""
    for part in range(parts):
        df.where(F.col("_part") == part).drop(
            "_part"
        ).coalesce(1).write.mode("append").parquet(str(folder))
    schema = df.drop("_part").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_flicker_stream_equals_batch(spark, tmp_path):
    """Frames come one micro-batch late or early; the last micro-batch only moves the watermark."""
    rng = np.random.default_rng(4)
    rows = [
        (v, "m", n, rng.random(50).tolist(), rng.random(50).tolist(), n // 3 + int(rng.integers(0, 2)))
        for v in range(3) for n in range(9)
    ] + [(9, "m", 0, [1.0] * 50, [1.0] * 50, 0)]
    end = [(99, "m", 1000, [0.0], [0.0], 4)]
    schema = "video long, variant string, frame long, pred array<double>, target array<double>, _part int"
    df, marked = spark.createDataFrame(rows, schema), spark.createDataFrame(rows + end, schema)
    timed = marked.withColumn("ts", F.timestamp_seconds(F.col("frame") + 100))
    stream = arriving(spark, timed, tmp_path / "in", 5)
    stored = run(flicker_steps(tiles(stream, size=16), "4 seconds"), tmp_path / "out")
    keys = ["video", "variant"]
    got = flick.flicker(frame_steps(stored), keys).orderBy("video").toPandas()
    pixels = df.select("video", "variant", "frame", F.posexplode(F.arrays_zip("pred", "target")).alias("x", "z"))
    pixels = pixels.select("video", "variant", "frame", "x", "z.pred", "z.target")
    want = flick.flicker(flick.transitions(pixels, keys, "frame", ["x"]), keys).orderBy("video").toPandas()
    assert got["video"].tolist() == want["video"].tolist()
    np.testing.assert_allclose(got["flicker_excess"], want["flicker_excess"], rtol=1e-9)
    assert got["temporal"].iloc[-1] == flick.SINGLE


PARAMS = "video long, ordinal long, x double, _part int"


def params(df):
    return df.select("video", F.timestamp_seconds(F.col("ordinal") + 100).alias("ts"), "ordinal", F.array("x").alias("params"), "_part")


def test_ema_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(v, n, float(rng.normal()), n // 10 + int(rng.integers(0, 2))) for v in range(3) for n in range(40)]
    df = spark.createDataFrame(rows, PARAMS)
    stream = arriving(spark, params(spark.createDataFrame(rows + [(99, 1000, 0.0, 5)], PARAMS)), tmp_path / "in", 6)
    stored = run(smoothed(stream, 0.8, "11 seconds"), tmp_path / "out")
    got = stored.select("video", "ordinal", F.get("applied", F.lit(0)).alias("x")).orderBy("video", "ordinal").toPandas()
    want = smooth(df, ["video"], "ordinal", ["x"], 0.8).orderBy("video", "ordinal").toPandas()
    np.testing.assert_allclose(got["x"], want["x"], rtol=1e-9)


def test_state_is_bounded_and_late_rows_are_counted(spark, tmp_path):
    """Rows wait no longer than the watermark; a quiet video is forgotten and starts afresh; a row behind
    the watermark is left out and counted."""
    rows = [(0, n, float(n), n // 10) for n in range(60)] + [(1, n, 1.0, 0) for n in range(3)] + [(1, 58, 5.0, 5)]
    rows += [(0, 5, -1.0, 5), (99, 1000, 0.0, 6)]
    stream = arriving(spark, params(spark.createDataFrame(rows, PARAMS)), tmp_path / "in", 7)
    made = smoothed(stream, 0.5, "10 seconds", quiet_ms=20_000)
    query = made.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "s"))
    query = query.trigger(availableNow=True).start(str(tmp_path / "o"))
    assert query.awaitTermination(240)
    told = [p.stateOperators[0] for p in query.recentProgress if p.stateOperators]
    assert sum(t.numRowsDroppedByWatermark for t in told) == 1
    stored = spark.read.parquet(str(tmp_path / "o"))
    got = {(r.video, r.ordinal): r.applied[0] for r in stored.collect()}
    assert len(got) == 60 + 4 and stored.count() == 64
    assert got[1, 2] == 1.0 and got[1, 58] == 5.0
    # Of the 60 rows of a video no more wait than two micro-batches hold, and one state per video.
    assert max(t.numRowsTotal for t in told) <= 40


def test_rows_in_order_call_python_by_bucket(spark, tmp_path, monkeypatch):
    """Many videos, one of them null, over several micro-batches: state rows are as many as buckets."""
    monkeypatch.setattr(order, "BUCKETS", 2)
    rows = [(None if v == 3 else 2**53 + v, n, float(v + n), n // 3) for v in range(30) for n in range(9)] + [(99, 1000, 0.0, 3)]
    stream = arriving(spark, params(spark.createDataFrame(rows, PARAMS)), tmp_path / "in", 4)
    query = smoothed(stream, 0.5, "2 seconds").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "s"))
    query = query.trigger(availableNow=True).start(str(tmp_path / "o"))
    assert query.awaitTermination(240)
    # A bucket has what came with three micro-batches at most, what its videos left, and two kinds of timers.
    assert max(p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators) <= 2 * 12
    got = {(r.video, r.ordinal): r.applied[0] for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    want = {}
    for video, n, value, _ in rows[:-1]:
        want[video, n] = value if n == 0 else 0.5 * want[video, n - 1] + 0.5 * value
    assert got == want


def test_curation_stream_takes_each_frame_once(spark, tmp_path):
    """Videos of several frames over several micro-batches, run twice on one checkpoint and once on another."""
    rows = [(v, f, f % 2) for v in "abc" for f in range(3)] + [("a", 0, 1), ("d", 7, 1)]
    df = spark.createDataFrame(rows, "video string, frame int, _part int")
    stream = arriving(spark, df, tmp_path / "in", 2)
    for state in ("s", "s", "other"):
        query = curate_stream(stream, lambda b: b.withColumn("tmo", F.lit("x")), str(tmp_path / "m"), str(tmp_path / state))
        assert query.awaitTermination(120)
        got = sorted((r["video"], r["frame"]) for r in spark.read.parquet(str(tmp_path / "m")).collect())
        assert got == sorted({(v, f) for v, f, _ in rows})


def test_frames_are_written_as_they_arrive(spark, tmp_path):
    df = spark.createDataFrame(
        [(n, 2, 2, *([0.1 * n] * 4 for _ in range(3)), n) for n in range(3)],
        "frame int, height int, width int, r array<double>, g array<double>, b array<double>, _part int",
    )
    stream = arriving(spark, df, tmp_path / "in", 3)
    assert write_frames(stream, str(tmp_path / "png"), str(tmp_path / "s")).awaitTermination(120)
    assert sorted(p.name for p in (tmp_path / "png").iterdir()) == [f"hdr_{n:06d}.png" for n in range(3)]


def test_aggregate_on_a_stream_calls_python_by_bucket(spark, tmp_path, monkeypatch):
    """Keys with nulls over three micro-batches; state rows are as many as buckets, not as many as keys."""
    monkeypatch.setattr(stream_aggregate, "BUCKETS", 2)
    rows = [(None if v == 3 else v, f"k{v % 2}", float(n), n % 3) for v in range(2**53, 2**53 + 9) for n in range(7)] + [(None, None, 5.0, 2)]
    df = spark.createDataFrame(rows, "v long, k string, x double, _part int")
    total = summed(["x"], 2, lambda c: np.array([len(c[0]), c[0].sum()]), lambda s: [int(s[0]), s[1]], "n bigint, total double")
    stream = stream_aggregate.aggregated_stream(arriving(spark, df, tmp_path / "in", 3), ["v", "k"], total)
    query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "s"))
    query = query.trigger(availableNow=True).start(str(tmp_path / "o"))
    assert query.awaitTermination(120)
    assert max(p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators) <= 2
    given = spark.read.parquet(str(tmp_path / "o"))
    got = given.groupBy("v", "k").agg(F.max_by(F.struct("n", "total"), "updates").alias("l")).select("v", "k", "l.*")
    want = df.groupBy("v", "k").agg(F.count("x").alias("n"), F.sum("x").alias("total"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize(
    ("name", "read"), [("curate_stream", "documents"), ("curate_stream_turns", "conversations"), ("picture_stream", "embeddings")]
)
def test_a_table_may_be_a_folder_of_files(spark, tmp_path, name, read):
    """Larger tables come as several files each, and every row of them arrives."""
    catalog.load()
    table = spark.read.parquet(f"{FOLDER}/{read}.parquet")
    table.repartition(3).write.parquet(str(tmp_path / f"{read}.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {read} AS SELECT * FROM '{FOLDER}/{read}.parquet'")
    count, wrong = compare(catalog.QUERIES[name](spark, str(tmp_path)), con, catalog.ORACLES[name])
    assert not wrong and count > 0


def test_bad_alpha(spark):
    with pytest.raises(ValueError):
        smoothed(spark.range(1), 1.0)
