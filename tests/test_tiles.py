"""Frames in tiles against the same operators on whole frames, tile sides that do not divide included."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from nitlake.operators import frames as fr, tiles as tl

SIZES = [(13, 17), (16, 16), (1, 9), (7, 1), (5, 30)]


@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(3)
    rows = []
    for key, (h, w) in enumerate(SIZES):
        a = rng.random((h, w))
        b = np.clip(a + 0.05 * rng.random((h, w)), 0, 1)
        rows.append((key, h, w, a.ravel().tolist(), b.ravel().tolist(), np.arange(h * w).tolist()))
    return spark.createDataFrame(rows, "key int, height int, width int, p array<double>, t array<double>, n array<int>")


def whole(cut, plane):
    """Planes put together again by hand."""
    made = {}
    for r in cut.collect():
        plane_of = made.setdefault(r["key"], np.full((r["height"], r["width"]), np.nan))
        top, left = r["tile_row"] * r["tile"], r["tile_column"] * r["tile"]
        h, w = min(r["tile"], r["height"] - top), min(r["tile"], r["width"] - left)
        plane_of[top : top + h, left : left + w] = np.reshape(r[plane], (h, w))
    return made


@pytest.mark.parametrize("size", [1, 4, 5, 64])
def test_cut(frames, size):
    made = whole(tl.to_tiles(frames, ["key"], ["p", "n"], size), "n")
    for key, (h, w) in enumerate(SIZES):
        assert np.array_equal(made[key].ravel(), np.arange(h * w))


@pytest.mark.parametrize("size", [2, 4, 5, 64])
def test_gradient_and_similarity(frames, size):
    cut = tl.to_tiles(frames, ["key"], ["p", "t"], size)
    found = whole(tl.log_gradient(cut, ["key"], "p"), "gradient")
    same = frames.select("key", fr.log_gradient("p", "height", "width").alias("g"), fr.ssim_of_codes("p", "t", "height", "width").alias("s"))
    scores = {r["key"]: r["ssim"] for r in tl.ssim(cut, ["key"], "p", "t").collect()}
    for r in same.collect():
        np.testing.assert_array_equal(found[r["key"]].ravel(), r["g"])
        assert scores[r["key"]] == pytest.approx(r["s"], abs=1e-12)


@pytest.mark.parametrize("size", [3, 4, 64])
def test_spectrum(frames, size):
    cut = tl.to_tiles(frames, ["key"], ["p"], size)
    found = tl.spectral_bands(cut, ["key"], "p", 5).collect()
    got = {(r["key"], r["band"]): r["energy"] for r in found}
    assert len(found) == 5 * len(SIZES)
    for r in frames.select("key", fr.spectral_bands(5)("p", "height", "width").alias("e")).collect():
        for band, energy in enumerate(r["e"]):
            assert got[r["key"], band] == pytest.approx(energy, abs=1e-12)


@pytest.mark.parametrize(("size", "made"), [(1, 3), (4, 5), (5, None), (64, 2)])
@pytest.mark.parametrize("wanted", [(3, 3), (8, 21), (13, 17), (1, 1)])
def test_resize_and_pooling(frames, size, made, wanted):
    """Larger, smaller, of the same size, and down to one pixel."""
    cut = tl.to_tiles(frames, ["key"], ["p", "n"], size)
    h, w, to_h, to_w = F.col("height"), F.col("width"), F.lit(wanted[0]), F.lit(wanted[1])
    for plane, run, same in (("p", tl.resized, fr.bilinear), ("n", tl.resized, fr.bilinear), ("p", tl.pooled, fr.grid_pool)):
        found = whole(run(cut, ["key"], plane, *wanted, size=made), "out")
        plain = frames.select("key", same(F.col(plane).cast("array<double>"), h, w, to_h, to_w).alias("o")).collect()
        assert sorted(found) == list(range(len(SIZES)))
        for r in plain:
            assert found[r["key"]].shape == wanted
            np.testing.assert_allclose(found[r["key"]].ravel(), r["o"], atol=1e-11)


def test_resize_needs_all_tiles(frames):
    cut = tl.to_tiles(frames, ["key"], ["p"], 4)
    for wrong in (cut.where("NOT (tile_row = 1 AND tile_column = 1)"), cut.union(cut)):
        with pytest.raises(Exception, match="missing or repeated"):
            tl.pooled(wrong, ["key"], "p", 3, 3).collect()
    assert tl.pooled(cut.limit(0), ["key"], "p", 3, 3).count() == 0
    with pytest.raises(ValueError, match="at least one row"):
        tl.resized(cut, ["key"], "p", 0, 3)


@pytest.mark.parametrize(("size", "asked", "named"), [(4, 64, 1000), (5, 1, 2)])
def test_crops(spark, frames, monkeypatch, tmp_path, size, asked, named):
    """Cuts at every kind of place, several of one frame, larger than the frame, and of no frame."""
    monkeypatch.setattr(tl, "ASKED", asked)
    monkeypatch.setattr(tl, "NAMED", named)
    tl.write_tiles(tl.to_tiles(frames, ["key"], ["n"], size), str(tmp_path / "store"), ["key"])
    store = spark.read.parquet(str(tmp_path / "store"))
    rows, side = [], 6
    for key, (h, w) in enumerate(SIZES):
        for i in range(5):
            rows.append((f"{key}-{i}", key, (i * 3) % (max(h - side, 0) + 1), (i * 5) % (max(w - side, 0) + 1)))
    windows = spark.createDataFrame([*rows, ("none", 99, 0, 0)], "id string, key int, top int, left int")
    found = {r["id"]: np.reshape(r["n"], (side, side)) for r in tl.crops(store, ["key"], windows, ["id"], ["n"], side).collect()}
    assert sorted(found) == sorted(r[0] for r in rows)
    for name, key, top, left in rows:
        h, w = SIZES[key]
        plane = np.arange(h * w).reshape(h, w)
        y, x = np.minimum(top + np.arange(side), h - 1), np.minimum(left + np.arange(side), w - 1)
        assert np.array_equal(found[name], plane[np.ix_(y, x)])
    assert tl.crops(store, ["key"], windows.limit(0), ["id"], ["n"], side).count() == 0


def test_reading_falls_with_the_share_of_the_crop(spark, tmp_path):
    """The filters reach the scan, and pages that no window meets are left out."""
    side, count = 64, 40
    table = pd.DataFrame({"key": np.arange(count), "height": side, "width": side})
    frames = spark.createDataFrame(table).withColumns(
        {c: F.col(c).cast("int") for c in ("height", "width")} | {"n": F.sequence(F.lit(0), F.lit(side * side - 1))}
    )
    path = str(tmp_path / "store")
    tl.write_tiles(tl.to_tiles(frames, ["key"], ["n"], 8), path, ["key"])
    store = spark.read.parquet(path)

    def read(keys):
        wanted = spark.createDataFrame([(k, 0, 1) for k in keys], "key long, tile_row int, tile_column int")
        some = tl.tiles_within(store, ["key"], wanted).select("key", "n")
        executed = some._jdf.queryExecution().executedPlan()
        leaves = executed.collectLeaves()
        scans = [leaves.apply(i) for i in range(leaves.size())]
        pushed = str(scans[0].metadata().apply("PushedFilters"))
        executed.execute().count()
        return pushed, sum(scan.metrics().apply("numOutputRows").value() for scan in scans)

    all_rows = 64 * count
    pushed, few = read([3, 21])
    assert "tile_row" in pushed and "key" in pushed
    assert 2 <= few < all_rows / 10
    _, more = read(range(0, count, 3))
    assert few < more < all_rows * 0.6


def test_missing_tiles_are_an_error(frames):
    cut = tl.to_tiles(frames, ["key"], ["p"], 4).where("NOT (tile_row = 1 AND tile_column = 1)")
    with pytest.raises(Exception, match="missing or repeated"):
        tl.spectral_bands(cut, ["key"], "p").collect()
    with pytest.raises(ValueError, match="at least 1"):
        tl.to_tiles(frames, ["key"], ["p"], 0)


def test_similarity_of_small_tiles_is_taken_together(spark, monkeypatch):
    """Tiles alike in size and place in the frame are one call, and the result is that of whole frames."""
    rng, calls, whole = np.random.default_rng(3), [], tl.similarity_map
    rows = [(n, 8, 8, rng.random(64).tolist(), rng.random(64).tolist()) for n in range(40)]
    frames = spark.createDataFrame(rows, "id long, height int, width int, a array<double>, b array<double>")
    cut = tl.to_tiles(frames, ["id"], ["a", "b"], 5).coalesce(1)
    got = {r.id: r.ssim for r in tl.ssim(cut, ["id"], "a", "b").collect()}
    want = [float(np.mean(whole(*(fr.pu21_units(np.array(p).reshape(8, 8)) for p in r[3:])))) for r in rows]
    assert np.allclose([got[n] for n in range(40)], want, atol=1e-12)
    made = {}
    monkeypatch.setattr(tl, "with_edges", lambda t, k, p, r, work, out, **more: made.update(work=work, **more) or t.selectExpr("id", "0D _sum", "1 _pixels"))
    tl.ssim(cut, ["id"], "a", "b")
    monkeypatch.setattr(tl, "similarity_map", lambda one, other: calls.append(one.shape) or whole(one, other))
    stack = np.array([r[3] for r in rows]).reshape(40, 8, 8)
    assert made["stacked"] and len(made["work"]([stack, stack], ((5, 5), (5, 5)))) == 40 and len(calls) == 1
