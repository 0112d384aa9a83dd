"""Known values, round trips and invariants of the colour functions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nitlake.functions import curves, gamut, light, spaces, spline, tone, transfer
from nitlake.functions.common import RGB, num, rgb


@pytest.fixture(scope="module")
def ramp(spark):
    return spark.range(0, 1001).select((F.col("id") / 1000).alias("x"))


def worst(df, one, other):
    return df.select(F.max(F.abs(one - other))).first()[0]


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_known_values(spark):
    assert value(spark, transfer.pq_oetf_nits(num(100))) == pytest.approx(0.5081, abs=1e-4)
    assert value(spark, transfer.pq_oetf_nits(num(1000))) == pytest.approx(0.7518, abs=1e-4)
    assert value(spark, transfer.pq_eotf_nits(num(1))) == pytest.approx(10000, rel=1e-9)
    for nits, units in ((0.005, 0.0), (100, 256.3839), (10000, 595.3939)):
        assert value(spark, spaces.pu21_encode(num(nits))) == pytest.approx(units, abs=1e-3)
    assert value(spark, curves.method_c(num(1000))) == pytest.approx(100)
    assert value(spark, curves.method_c(num(0))) == 0
    assert value(spark, curves.reinhard(num(1000))) == pytest.approx(100)


def test_round_trips(ramp):
    x = F.col("x")
    pairs = [
        (transfer.pq_oetf, transfer.pq_eotf, 1e-6),
        (transfer.bt709_oetf, transfer.bt709_eotf, 1e-3),
        (transfer.hlg_oetf, transfer.hlg_inverse, 1e-6),
        (transfer.bt1886_inverse, transfer.bt1886_eotf, 1e-9),
    ]
    for there, back, close in pairs:
        assert worst(ramp, back(there(x)), x) < close
    nits = x * 9999 + 0.01
    assert worst(ramp, spaces.pu21_decode(spaces.pu21_encode(nits)) / nits, num(1)) < 1e-6
    for curve, back in ((curves.method_c, curves.method_c_inverse), (curves.reinhard, curves.reinhard_inverse)):
        assert worst(ramp, back(curve(x * 1000)), x * 1000) < 1e-6


def test_gamut_keeps_white_and_inverts():
    for matrix in (gamut.TO_709, gamut.TO_2020):
        np.testing.assert_allclose(matrix.sum(axis=1), 1, atol=1e-12)
    np.testing.assert_allclose(gamut.TO_709 @ gamut.TO_2020, np.eye(3), atol=1e-12)
    with pytest.raises(ValueError):
        gamut.crosstalk(0.34)


def test_neutral_axis(ramp):
    gray = RGB(F.col("x"), F.col("x"), F.col("x"))
    _, ct, cp = spaces.pq_ictcp(gray)
    assert worst(ramp, ct, num(0)) < 1e-9 and worst(ramp, cp, num(0)) < 1e-9
    _, cb, cr = spaces.to_ycbcr(gray)
    assert worst(ramp, cb, num(0)) < 1e-12 and worst(ramp, cr, num(0)) < 1e-12


def test_tone_operators_rise_and_stay_in_range(spark):
    steps = spark.range(64).select(F.pow(num(10), F.col("id") * 3 / 63).alias("n"), "id")
    code = transfer.pq_oetf_nits(F.col("n"))
    grid = tone.tone_grid(steps.select("id", *(code.alias(c) for c in "rgb")))
    rows = grid.toPandas()
    assert sorted(rows["tmo"].unique()) == sorted(tone.TONE_OPERATORS) and len(rows) == 64 * 8
    for name, group in rows.groupby("tmo"):
        gray = group.sort_values("id")["sg"].to_numpy()
        assert (np.diff(gray) >= -1e-9).all(), name
        assert gray.min() >= 0 and gray.max() <= 1 and gray[-1] > gray[0]
    one = tone.tone_map(steps.select("id", *(code.alias(c) for c in "rgb")), "reinhard")
    wide = one.join(rows_of(grid, "reinhard"), "id")
    assert worst(wide, F.col("sr"), F.col("gr")) == 0
    with pytest.raises(KeyError, match="unknown tone operator"):
        tone.tone_map(steps, "nope")
    with pytest.raises(ValueError):
        curves.check_peak(0)


def rows_of(grid, name):
    return grid.where(F.col("tmo") == name).select("id", F.col("sr").alias("gr"))


def test_inverses_undo_their_operators(spark):
    """The coloured gradient within BT.709: forward, back, at least 35 dB and at most 8 dE."""
    from nitlake.operators.metrics import pixel_scores

    place = spark.range(256 * 256 // 16).selectExpr("0.01D + 0.99D * (id % 64) / 63 AS x", "0.1D + 0.8D * (id div 64) / 63 AS y")
    mixed = RGB(*(num(a) * F.col("x") + num(b) * F.col("y") for a, b in ((0.7, 0.2), (0.6, 0.25), (0.5, 0.3))))
    nits = gamut.from_709(mixed.map(lambda c: c * num(1000)))
    df = place.select(*(transfer.pq_oetf_nits(c).alias("t" + n) for c, n in zip(nits, "rgb")))
    for name, back in (("bt2446c_gm", tone.invert_bt2446c), ("reinhard", tone.invert_reinhard)):
        undone = back(tone.tone_map(df, name, codes="t"), signal="s", out="p")
        score = pixel_scores(undone, []).first()
        assert score["psnr"] >= 35 and score["deitp"] <= 8, name


def test_unknown_formats_fail(spark):
    df = spark.createDataFrame([(0.5, 0.5, 0.5, "odd")], "r double, g double, b double, f string")
    with pytest.raises(ValueError):
        light.normalise(rgb(""), "odd")
    with pytest.raises(Exception, match="unknown source format"):
        df.select(*light.normalise_by(rgb(""), F.col("f"))).collect()


def test_splines(spark):
    flat = [F.array(*(num(0) for _ in range(8))), F.array(*(num(0) for _ in range(8)))]
    straight = F.array(*(num(spline.STRAIGHT) for _ in range(9)))
    df = spark.range(0, 101).select((F.col("id") / 100).alias("x"))
    laid = spline.lay_curve(df, *flat, straight, 8)
    same = spline.apply_curve(laid, F.col("x"), "o", 8)
    assert worst(same, F.col("o"), F.col("x")) < 1e-9
    bent = [F.array(*(num(math.sin(i * k)) for i in range(n))) for k, n in ((1, 8), (2, 8), (3, 9))]
    rows = spline.apply_curve(spline.lay_curve(df, *bent, 8), F.col("x"), "o", 8).orderBy("x").toPandas()["o"]
    assert rows.iloc[0] == 0 and rows.iloc[-1] == pytest.approx(1) and (rows.diff().dropna() > 0).all()
    assert value(spark, spline.roughness(*flat, straight, 8)) == pytest.approx(0, abs=1e-12)
