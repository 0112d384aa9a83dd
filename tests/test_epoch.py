"""An epoch from tile stores beside the same epoch from whole frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nitlake.operators import tiles as tl
from nitlake.plans.epoch import stored_epoch, training_epoch


@pytest.fixture(scope="module")
def corpus(spark):
    """Records of frames of three sizes; two variants a frame, one frame with many."""
    rng = np.random.default_rng(1)
    hdr, sdr, records = [], [], []
    for frame, (h, w) in enumerate([(9, 12), (20, 5), (8, 8), (11, 11)]):
        planes = lambda top: [rng.integers(0, top, h * w).tolist() for _ in "rgb"]  # noqa: B023, E731
        hdr.append((f"h{frame}", h, w, *planes(65536)))
        for variant in range(20 if frame == 0 else 2):
            key = f"s{frame}-{variant}"
            sdr.append((key, h, w, *planes(256)))
            records.append((f"h{frame}", key, "v", frame, "expert", None, "train", "x"))
    shape = "key string, height int, width int, r array<int>, g array<int>, b array<int>"
    names = "hdr_key string, sdr_key string, video string, frame int, tmo string, crf int, split string, source_dataset string"
    return spark.createDataFrame(records, names), spark.createDataFrame(hdr, shape), spark.createDataFrame(sdr, shape)


def stores(corpus, size):
    return [tl.to_tiles(side, ["key"], list("rgb"), size) for side in corpus[1:]]


def plain(df):
    return sorted(tuple(tuple(v) if isinstance(v, list) else v for v in row) for row in df.drop("crf").collect())


@pytest.mark.parametrize(("size", "flip"), [(4, True), (64, False)])
def test_same_rows(corpus, size, flip):
    records, hdr, sdr = corpus
    want = training_epoch(records, hdr, sdr, seed=5, epoch=2, batch=4, crop=7, flip=flip)
    found = stored_epoch(records, *stores(corpus, size), seed=5, epoch=2, batch=4, crop=7, flip=flip)
    assert found.columns == want.columns and found.dtypes == want.dtypes
    assert plain(found) == plain(want)


def test_some_batches(corpus):
    whole = stored_epoch(corpus[0], *stores(corpus, 5), seed=5, epoch=2, batch=4, crop=7)
    some = stored_epoch(corpus[0], *stores(corpus, 5), seed=5, epoch=2, batch=4, crop=7, batches=(1, 3))
    assert plain(some) == plain(whole.where("batch_id IN (1, 2)")) and some.count() == 8


def test_sides_that_differ(corpus):
    records, hdr, sdr = corpus
    wrong = hdr.withColumns({"height": F.col("width"), "width": F.col("height")})
    with pytest.raises(Exception, match="shapes of a pair differ"):
        stored_epoch(records, *stores((records, wrong, sdr), 4), seed=5, epoch=2, batch=4, crop=7).collect()
