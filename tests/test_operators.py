"""Operators against brute force, with the limits lowered so that every path runs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from nitlake.operators.attach import attach
from nitlake.operators import codec, frames as fr, pack, select
from nitlake.operators.numbering import every_nth, number_rows
from nitlake.operators.quantile import quantiles
from nitlake.operators.sampling import balanced_draw, epoch_batches, shared_noise
from nitlake.operators.scan import smooth


@pytest.fixture(scope="module")
def skewed(spark):
    """One key with a third of all rows, many small ones, ties, nulls and both signs."""
    rng = np.random.default_rng(5)
    keys = np.where(np.arange(6000) % 3 == 0, 0, rng.integers(1, 40, 6000))
    values = np.where(rng.random(6000) < 0.3, 2.5, rng.normal(size=6000) * 10.0 ** rng.integers(-9, 6, 6000))
    values[rng.random(6000) < 0.05] = np.nan
    table = pd.DataFrame({"k": keys, "id": np.arange(6000), "v": values})
    df = spark.createDataFrame(table).withColumn("v", F.nanvl("v", F.lit(None).cast("double")))
    return df, table


@pytest.mark.parametrize("gathered", [10**6, 500, 0])
def test_quantiles(skewed, gathered):
    df, table = skewed
    wanted = [0.0, 0.5, 0.95, 0.995, 1.0]
    names = ["a", "b", "c", "d", "e"]
    found = quantiles(df, ["k"], "v", wanted, names, gathered=gathered).toPandas().set_index("k")
    exact = table.groupby("k")["v"].quantile(wanted).unstack()
    np.testing.assert_allclose(found.loc[exact.index, names], exact, rtol=1e-12)
    lower = quantiles(df, ["k"], "v", [0.5], ["m"], True, gathered).toPandas().set_index("k")["m"]
    for key, group in table.dropna().groupby("k")["v"]:
        assert lower[key] == np.sort(group)[(len(group) - 1) // 2]


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, 3.0)], "k int, v double")
    for gathered in (10, 0):
        assert [tuple(r) for r in quantiles(df, ["k"], "v", [0.5], ["m"], gathered=gathered).collect()] == [(2, 3.0)]


def test_attach_broadcasts_only_few_groups(skewed):
    df, table = skewed
    sums = df.groupBy("k").agg(F.count("v").alias("n"))
    few, many = attach(df, sums, ["k"]), attach(df, sums, ["k"], broadcast_rows=3)
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(few) and "strategy=broadcast" not in plan(many)
    assert few.count() == many.count() == len(table)
    assert few.exceptAll(many).isEmpty()


def test_number_rows(skewed):
    df, table = skewed
    expected = table.sort_values("id").groupby("k").cumcount()
    for buckets in ([F.floor(F.col("id") / 100)], None,
                    [F.floor(F.col("id") / 1000), F.floor(F.col("id") / 10)]):
        found = number_rows(df, ["id"], ["k"], buckets).toPandas().set_index("id")["n"]
        assert (found.sort_index() == expected.to_numpy()).all()
    everywhere = number_rows(df.select("id"), ["id"], buckets=[F.floor(F.col("id") / 64)]).toPandas()
    assert (everywhere["id"] == everywhere["n"]).all()
    assert every_nth(df, "id", 7).count() == len(range(0, 6000, 7))
    with pytest.raises(ValueError):
        every_nth(df, "id", 0)


@pytest.mark.parametrize("alpha", [0.0, 0.1, 0.8, 0.999])
def test_smooth(spark, alpha):
    rng = np.random.default_rng(1)
    table = pd.DataFrame({"k": [0] * 3000 + [1] * 5, "n": [*range(3000), *range(5)], "v": rng.normal(size=3005)})
    found = smooth(spark.createDataFrame(table), ["k"], "n", ["v"], alpha).toPandas()
    for key, group in table.groupby("k"):
        applied, last = [], None
        for value in group["v"]:
            last = value if last is None else alpha * last + (1 - alpha) * value
            applied.append(last)
        got = found[found.k == key].sort_values("n")["v"]
        np.testing.assert_allclose(got, applied, rtol=1e-9, atol=1e-12)
    with pytest.raises(ValueError):
        smooth(spark.createDataFrame(table), ["k"], "n", ["v"], 1.0)


def test_pack_over_many_batches(spark):
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 400, 3000)
    sizes[::97] = 2500
    items = spark.createDataFrame(
        pd.DataFrame({"ordinal": np.arange(3000), "size": sizes, "writer": np.arange(3000) % 2})
    )
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        found = pack.pack(items, "ordinal", "size", 1000).toPandas().sort_values("ordinal")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for writer in (0, 1):
        shard, filled, expected = 0, 0, []
        for size in sizes[writer::2]:
            if filled and filled + size > 1000:
                shard, filled = shard + 1, 0
            filled += size
            expected.append(shard)
        assert found[found.writer == writer]["shard"].tolist() == expected
    twice = found.assign(key="same")
    assert pack.duplicate_keys(spark.createDataFrame(twice), "key").count() > 0


def test_holdout_does_not_depend_on_order(spark):
    names = [f"{i:032x}" for i in range(30)]
    up = spark.createDataFrame([("chug", n) for n in names], "s string, v string")
    down = spark.createDataFrame([("chug", n) for n in reversed(names)], "s string, v string")
    one = {r["v"] for r in select.drawn(up, "s", "v", 10, 260402787).collect()}
    other = {r["v"] for r in select.drawn(down, "s", "v", 10, 260402787).collect()}
    assert one == other and len(one) == 10
    plan = select.drawn(up, "s", "v", 10, 1)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_balanced_draw(spark):
    rows = [("a", i) for i in range(900)] + [("b", i) for i in range(900, 1000)]
    df = spark.createDataFrame(rows, "c string, id long")
    drawn = balanced_draw(df, "c", "id", 3)
    counts = {r["c"]: r["count"] for r in drawn.groupBy("c").count().collect()}
    assert sum(counts.values()) == 1000 and abs(counts["a"] - 500) < 80
    single = balanced_draw(df.where("c = 'b'"), "c", "id", 3)
    assert sorted(r["id"] for r in single.collect()) == list(range(900, 1000))


def test_epochs_differ_and_are_whole(spark):
    df = spark.range(103).withColumnRenamed("id", "k")
    one = epoch_batches(df, ["k"], 1, 0, 10).collect()
    assert len(one) == 100 and len({r["k"] for r in one}) == 100
    two = {r["k"]: (r["batch_id"], r["place"]) for r in epoch_batches(df, ["k"], 1, 1, 10).collect()}
    assert any(two.get(r["k"]) != (r["batch_id"], r["place"]) for r in one)


def test_noise_is_shared_and_normal(spark):
    pixels = spark.range(20000).selectExpr("id % 2 AS frame", "7 AS video", "(id div 2) div 100 AS y", "(id div 2) % 100 AS x")
    noise = shared_noise(pixels, 3).toPandas()
    first, second = (noise[noise.frame == f].sort_values(["y", "x"])["noise_g"].to_numpy() for f in (0, 1))
    assert (first == second).all() and abs(first.mean()) < 0.05 and abs(first.std() - 1) < 0.05
    assert (noise["noise_r"] != noise["noise_g"]).any()


def test_patches_and_padding_undo(spark):
    plane = [float(i) for i in range(24)]
    df = spark.createDataFrame([(4, 6, plane, [x + 100 for x in plane])], "h int, w int, a array<double>, b array<double>")
    h, w = F.col("h"), F.col("w")
    packed = df.withColumn("p", fr.patches([F.col("a"), F.col("b")], h, w))
    row = packed.select("p", fr.unpatch(F.col("p"), 0, h, w), fr.unpatch(F.col("p"), 1, h, w)).first()
    assert list(row[1]) == plane and list(row[2]) == [x + 100 for x in plane]
    assert list(row[0][0]) == [0, 1, 6, 7, 100, 101, 106, 107]
    grown = df.select(fr.crop_back(fr.pad_to_multiple(F.col("a"), h, w, 16), F.lit(16), h, w).alias("o"))
    assert list(grown.first()["o"]) == plane
    even = spark.createDataFrame([(3, 5, [float(i) for i in range(15)])], "h int, w int, a array<double>")
    assert list(even.select(fr.even_crop(F.col("a"), h, w)).first()[0]) == [0, 1, 2, 3, 5, 6, 7, 8]


def test_repack_is_exact_and_guards(spark):
    frames = spark.createDataFrame(
        [(k, list(range(k * 100, k * 100 + 37 + k))) for k in range(6)], "k int, a array<int>"
    )
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        pixels = fr.spread_pixels(frames, ["k"], {"a": "a"})
        back = fr.repack(pixels, ["k"], ["a"]).collect()
        assert sorted(map(tuple, [(r["k"], tuple(r["a"])) for r in back])) == [
            (k, tuple(range(k * 100, k * 100 + 37 + k))) for k in range(6)
        ]
        with pytest.raises(Exception, match="missing|not together"):
            fr.repack(pixels.where("a % 5 <> 0"), ["k"], ["a"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_codec_floor(spark):
    y, x = np.mgrid[0:64, 0:64] / 63
    picture = np.rint(255 * np.stack([0.2 + 0.6 * x, 0.3 + 0.5 * y, 0.5 * (x + y)]))
    for quality, floor in ((75, 28), (20, 24)):
        lost = codec.frame_loss(picture, quality)
        assert 10 * np.log10(255**2 / np.mean((lost - picture) ** 2)) >= floor
    df = spark.createDataFrame(
        [(64, 64, crf, *(p.astype(int).ravel().tolist() for p in picture)) for crf in (23, None)],
        "height int, width int, crf int, r array<int>, g array<int>, b array<int>",
    )
    rows = {r["crf"]: r for r in codec.codec_loss(df).collect()}
    assert rows[None]["r"] == picture[0].astype(int).ravel().tolist()
    assert rows[23]["r"] == codec.frame_loss(picture, 75)[0].ravel().tolist()


@pytest.mark.parametrize("discrete", [False, True])
def test_quantiles_of_odd_numbers(spark, discrete):
    """Both paths agree on NaN, infinities, zeros of both signs and subnormal numbers."""
    inf, nan = float("inf"), float("nan")
    groups = {
        0: [*range(19), nan, nan, nan], 1: [*range(19), inf, inf, inf], 2: [-inf, -inf, *range(7), inf],
        3: [0.0, -0.0, 5e-324, -5e-324, 1e308, -1e308, 2.0], 4: [nan] * 9, 5: [-inf, inf] * 5, 6: [1.0, None, nan, None, -inf, 3.5],
    }
    rows = [(g, None if v is None else float(v)) for g, values in groups.items() for v in values]
    df = spark.createDataFrame(rows, "g long, v double")
    ask = [0.0, 0.25, 0.5, 0.9, 0.995, 1.0]
    names = [f"q{i}" for i in range(len(ask))]
    one, other = (
        quantiles(df, ["g"], "v", ask, names, discrete, gathered=n).orderBy("g").toPandas() for n in (10**6, 2)
    )
    np.testing.assert_allclose(one[names], other[names], rtol=1e-12, equal_nan=True)
    assert one["g"].tolist() == sorted(groups)


@pytest.mark.parametrize("alpha", [0.001, 0.8, 0.99, 0.9995])
def test_smoothing_forgets_nothing(spark, alpha):
    """Long sequences over many chunks, with one value that outweighs all others."""
    values = [1e60 if n == 3 else float(n % 7) for n in range(6_000)]
    df = spark.createDataFrame([(0, n, v) for n, v in enumerate(values)], "g long, n long, x double")
    got = [r["x"] for r in smooth(df, ["g"], "n", ["x"], alpha).orderBy("n").collect()]
    want = [values[0]]
    for value in values[1:]:
        want.append(alpha * want[-1] + (1 - alpha) * value)
    np.testing.assert_allclose(got, want, rtol=1e-7)
