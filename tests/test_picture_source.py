"""The data source of pictures: what is read, and what a job leaves."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nitlake.sinks.pictures import PictureStreamWriter, PictureWriter
from nitlake.sources import pictures
from nitlake.sources.png import decode_png

FRAME = "name string, height int, width int, r array<double>, g array<double>, b array<double>"


def made(spark, names, side=4, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(n, side, side + 1, *(rng.random(side * (side + 1)).tolist() for _ in range(3))) for n in names]
    return spark.createDataFrame(rows, FRAME), rows


@pytest.fixture
def known(spark):
    pictures.register(spark)
    return spark


def test_round_trip_and_headers(known, tmp_path):
    df, rows = made(known, ["a/one.png", "a/two.png", "b/three.png"])
    df.write.format("pictures").mode("append").option("depth", 16).save(str(tmp_path))
    df.limit(1).withColumn("name", F.lit("eight.png")).write.format("pictures").mode("append").option("depth", 8).save(str(tmp_path))
    found = known.read.format("pictures").load(str(tmp_path))
    got = {r.path.removeprefix(f"{tmp_path}/"): r for r in found.collect()}
    assert set(got) == {"a/one.png", "a/two.png", "b/three.png", "eight.png"}
    for name, height, width, *planes in rows:
        row = got[name]
        assert (row.height, row.width, row.depth, row.colour, row.tag) == (height, width, 16, 2, "09100001")
        np.testing.assert_array_equal([row.r, row.g, row.b], np.rint(np.array(planes) * 65535))
        assert row.bytes == (tmp_path / name).stat().st_size
    assert got["eight.png"].tag is None and max(got["eight.png"].r) < 256


def test_only_what_is_asked_for_is_read(known, tmp_path):
    """Headers of pictures whose data is broken are read; filters choose files and pictures before decoding."""
    df, _ = made(known, ["a/one.png", "b/two.png"])
    df.write.format("pictures").mode("append").save(str(tmp_path))
    whole = (tmp_path / "b" / "two.png").read_bytes()
    (tmp_path / "b" / "two.png").write_bytes(whole[:70] + b"broken")
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "three.png").write_bytes(b"no picture")
    (tmp_path / "c" / "four.txt").write_text("no picture")
    names = known.read.format("pictures").schema("path string").load(str(tmp_path))
    assert names.count() == 3
    headers = known.read.format("pictures").schema("path string, width int").load(str(tmp_path))
    some = headers.where(~F.col("path").contains("/c/"))
    with pytest.raises(Exception, match="not a PNG"):
        headers.collect()
    with pytest.raises(Exception, match="not a PNG"):
        some.collect()  # a negation is left to Spark, which sees rows that were read
    assert [r.width for r in headers.where(F.col("path").endswith("two.png")).collect()] == [5]
    planes = known.read.format("pictures").load(str(tmp_path))
    assert planes.where(F.col("path").contains("/a/")).count() == 1
    assert planes.where(F.col("path").startswith(f"{tmp_path}/b")).where("width > 5").collect() == []
    with pytest.raises(Exception, match="no such columns"):
        known.read.format("pictures").schema("path string, colours int").load(str(tmp_path)).collect()


def test_tasks_by_bytes_and_files(known, tmp_path):
    df, _ = made(known, [f"{n:03d}.png" for n in range(20)])
    df.write.format("pictures").mode("append").save(str(tmp_path))
    reader = known.read.format("pictures")
    assert reader.load(str(tmp_path)).rdd.getNumPartitions() == 1
    assert reader.option("taskFiles", 6).load(str(tmp_path)).rdd.getNumPartitions() == 4
    small = reader.option("taskFiles", 1000).option("taskBytes", 1).load(str(tmp_path))
    assert small.rdd.getNumPartitions() == 20 and small.count() == 20


def batches(rows):
    kind = pa.list_(pa.float64())
    columns = list(zip(*rows, strict=True))
    kinds = [pa.string(), pa.int32(), pa.int32(), kind, kind, kind]
    return [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["name", "height", "width", "r", "g", "b"])]


def files(folder):
    return sorted(str(p.relative_to(folder)) for p in folder.rglob("*") if p.is_file())


def test_commit_and_abort(known, tmp_path):
    """A task that ran twice leaves one file; a job that failed leaves none; nothing shows before the commit."""
    df, rows = made(known, ["x/one.png", "two.png"])
    job = PictureWriter(str(tmp_path), df.schema, 16, True)
    job.write(iter(batches(rows)))  # its message is lost with its executor
    message = job.write(iter(batches(rows)))
    assert not any(name.startswith(("x", "two")) for name in files(tmp_path))
    job.commit([message, None, job.write(iter(()))])
    assert files(tmp_path) == ["two.png", "x/one.png"]
    failed = PictureWriter(str(tmp_path), df.schema, 8, False)
    failed.write(iter(batches(made(known, ["lost.png"])[1])))
    failed.abort([None])
    twice = PictureWriter(str(tmp_path), df.schema, 8, False)
    with pytest.raises(ValueError, match="one name"):
        twice.commit([twice.write(iter(batches(rows))), twice.write(iter(batches(rows)))])
    twice.abort([])
    assert files(tmp_path) == ["two.png", "x/one.png"]
    stream = PictureStreamWriter(str(tmp_path), df.schema, 16, True)
    for batch in (0, 0, 1):  # the first micro-batch runs again
        stream.commit([stream.write(iter(batches(rows)))], batch)
    assert files(tmp_path) == ["two.png", "x/one.png"]
    codes, chunks = decode_png((tmp_path / "two.png").read_bytes())
    np.testing.assert_array_equal(codes.reshape(3, -1), np.rint(np.array(rows[1][3:]) * 65535))
    assert chunks["cICP"] == bytes([9, 16, 0, 1])


def test_modes_and_refusals(known, tmp_path):
    one, _ = made(known, ["one.png", "old/two.png"])
    one.write.format("pictures").mode("append").save(str(tmp_path))
    other, _ = made(known, ["three.png", "one.png"], seed=2)
    other.write.format("pictures").mode("overwrite").save(str(tmp_path))
    assert files(tmp_path) == ["one.png", "three.png"]
    with pytest.raises(Exception, match="need the columns"):
        one.drop("b").write.format("pictures").mode("append").save(str(tmp_path))
    with pytest.raises(Exception, match="8 or 16"):
        one.write.format("pictures").mode("append").option("depth", 12).save(str(tmp_path))
    broken = one.withColumn("height", F.lit(3))
    with pytest.raises(Exception, match="reshape"):
        broken.write.format("pictures").mode("append").save(str(tmp_path))
    assert files(tmp_path) == ["one.png", "three.png"]
    empty = one.limit(0)
    empty.write.format("pictures").mode("append").save(str(tmp_path))
    assert files(tmp_path) == ["one.png", "three.png"]
