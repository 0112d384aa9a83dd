"""Models on frames in batches of one shape: same rows as frame by frame, loaded once a worker."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from nitlake.operators import frames as fr, models
from nitlake.plans.evaluate import evaluate_with

SHAPES = [(4, 6), (2, 3), (4, 6), (1, 1), (6, 4), (2, 3), (4, 6)]
SHAPE = "key int, height int, width int, a array<double>, b array<double>, c array<double>"


@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(2)
    rows = [(i, h, w, *(rng.random(h * w).tolist() for _ in "abc")) for i, (h, w) in enumerate(SHAPES * 6)]
    return spark.createDataFrame(rows, SHAPE).repartition(3)


def planes(df, names):
    return {r["key"]: [tuple(r[n]) if isinstance(r[n], list) else r[n] for n in names] for r in df.collect()}


@pytest.mark.parametrize("pixels", [1, 50, models.PIXELS])
def test_same_as_frame_by_frame(frames, pixels):
    """A model that doubles both sides."""
    grow = lambda frame: np.kron(frame, np.ones((1, 2, 2))) + frame.max()
    model = models.Model(lambda: lambda stack: np.stack([grow(frame) for frame in stack]), pixels)
    out = ["x", "y", "z", "out_height", "out_width"]
    found = models.model_frames(frames, model, list("abc"), out[:3])
    assert planes(found, out) == planes(fr.predict_frames(frames, grow, ("a", "b", "c"), tuple(out[:3])), out)
    assert found.columns == [*frames.columns, *out]


def test_batches_are_of_one_shape_and_bounded(frames):
    sized = models.Model(lambda: lambda stack: np.full(stack.shape, float(len(stack))), 96)
    found = models.model_frames(frames.coalesce(1), sized, list("abc"), list("xyz"))
    sizes = {r["key"]: (r["height"] * r["width"], r["x"][0]) for r in found.collect()}
    assert len(sizes) == len(SHAPES) * 6
    assert all(area * count <= 96 for area, count in sizes.values())
    assert max(count for _, count in sizes.values()) > 1


def test_loaded_once_a_worker(spark, frames, tmp_path):
    folder = str(tmp_path)

    def load():
        with open(f"{folder}/{os.getpid()}", "a") as log:
            log.write("loaded\n")
        return lambda stack: stack

    found = models.model_frames(frames.repartition(24), models.Model(load, 1), list("abc"), list("xyz"))
    assert found.count() == found.count() == len(SHAPES) * 6
    loads = [len((tmp_path / name).read_text().splitlines()) for name in os.listdir(tmp_path)]
    assert loads and set(loads) == {1}


def test_scores(frames):
    scorers = {
        "gap": models.Model(lambda: lambda one, other: np.abs(one - other).mean(axis=(1, 2, 3)), 40),
        "top": models.Model(lambda: lambda one, other: one.max(axis=(1, 2, 3))),
    }
    found = models.model_scores(frames, ["key"], scorers, ["a", "b"], ["b", "c"])
    rows = {r["key"]: r for r in frames.collect()}
    scores = {r["key"]: r for r in found.collect()}
    assert sorted(scores) == sorted(rows)
    for key, r in rows.items():
        one, other = np.array([r["a"], r["b"]]), np.array([r["b"], r["c"]])
        assert scores[key]["gap"] == pytest.approx(np.abs(one - other).mean())
        assert scores[key]["top"] == one.max()


def test_wrong_frames_and_models(frames):
    same = models.Model(lambda: lambda stack: stack)
    run = lambda df, model: models.model_frames(df, model, list("abc"), list("xyz")).collect()
    assert run(frames.limit(0), same) == []
    with pytest.raises(Exception, match="null or not of the size"):
        run(frames.withColumn("b", F.lit(None).cast("array<double>")), same)
    with pytest.raises(Exception, match="null or not of the size"):
        run(frames.withColumn("c", F.slice("c", 1, 1)), same)
    with pytest.raises(Exception, match="no height or no width"):
        run(frames.withColumn("height", F.lit(None).cast("int")), same)
    with pytest.raises(Exception, match="gave an array of shape"):
        run(frames, models.Model(lambda: lambda stack: stack[:, :2]))


def test_evaluation_of_a_model(spark):
    """Scores of a model are those of the same callable."""
    rng = np.random.default_rng(4)
    rows = []
    for i, side in enumerate([16, 12, 16]):
        sdr, hdr = rng.random((3, side * side)) * 0.5, rng.random((3, side * side))
        rows.append((i, f"c{i}", side, side, *(p.tolist() for p in (*sdr, *hdr))))
    names = [s + c for s in "st" for c in "rgb"]
    df = spark.createDataFrame(rows, "ordinal bigint, id string, height int, width int, " + ", ".join(f"{n} array<double>" for n in names))
    lit = lambda frame: frame * 1.5
    one = evaluate_with(df, lit).frames.orderBy("ordinal").collect()
    two = evaluate_with(df, models.Model(lambda: lit)).frames.orderBy("ordinal").collect()
    assert len(one) == 3 and one == two
