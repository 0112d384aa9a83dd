"""Evaluation, description and reports on tiny frames."""

import numpy as np
import pytest

from nitlake.functions.transfer import pq_code_of
from nitlake.operators import reduce
from nitlake.plans.describe import describe_frames, to_grid
from nitlake.plans.evaluate import evaluate, evaluate_with, select_records
from nitlake.plans.report import write_report
from nitlake.plans.stabilise import apply_to_pixels, stabilise
from nitlake.sinks.predictions import write_predictions
from nitlake.sources.predictions import load_predictions

SCHEMA = (
    "ordinal long, video string, frame_index int, variant string, track string, content_id string, "
    "height int, width int, p_height int, p_width int, "
    + ", ".join(f"{s}{c} array<double>" for s in "pt" for c in "rgb")
)


def row(ordinal, prediction, target, video="v", variant="m", track="synthetic", side=16, p_side=None):
    p_side = p_side or side
    flat = lambda x, n: [float(x)] * (n * n)
    return (ordinal, video, ordinal, variant, track, None, side, side, p_side, p_side,
            *(flat(prediction, p_side) for _ in range(3)), *(flat(target, side) for _ in range(3)))


def test_equal_frames_and_resize(spark):
    df = spark.createDataFrame([row(0, 0.4, 0.4), row(1, 0.4, 0.4, p_side=8)], SCHEMA)
    for r in evaluate(df).frames.collect():
        assert r["psnr"] == pytest.approx(175.496, abs=0.01) or r["psnr"] > 150
        assert r["ssim"] == pytest.approx(1) and r["deitp"] < 1e-3
        assert r["headline_protocol"] == "raw" and r["exposure_gain"] is None


def test_expert_gain(spark):
    dim, bright = pq_code_of(25), pq_code_of(50)
    df = spark.createDataFrame(
        [row(0, dim, bright, "e", "m", "Expert"), row(1, dim, bright, "s", "m")], SCHEMA
    )
    scores = evaluate(df)
    expert, raw = (scores.frames.where(f"video = '{v}'").first() for v in "es")
    assert expert["exposure_gain"] == pytest.approx(2.0, rel=1e-6)
    assert expert["exposure_calibrated_psnr"] > expert["psnr"] + 20
    assert expert["headline_protocol"] == "exposure_calibrated"
    assert raw["exposure_calibrated_psnr"] is None and raw["headline_protocol"] == "raw"
    total = {r["variant"]: r for r in scores.overall.collect()}
    assert total["ALL"]["headline_protocol"] == "mixed" and total["ALL"]["n_videos"] == 2


def test_flicker_and_single_frames(spark):
    codes = [pq_code_of(n) for n in (10, 30, 20)]
    rows = [row(i, c, codes[0], "a") for i, c in enumerate(codes)] + [row(9, 0.3, 0.3, "b")]
    videos = {r["video"]: r for r in evaluate(spark.createDataFrame(rows, SCHEMA), True).videos.collect()}
    a, b = videos["a"], videos["b"]
    assert a["flicker_reference"] == 0 and a["flicker_raw"] == a["flicker_excess"] > 0 and a["n_frames"] == 3
    assert b["flicker_raw"] is None and b["temporal"] == "skipped (single frame)" and a["temporal"] is None


def test_record_caps(spark):
    df = spark.createDataFrame([row(i, 0.3, 0.3) for i in range(4)], SCHEMA)
    assert evaluate(df, max_records=2).frames.count() == 2
    assert evaluate(df, max_records=0).frames.count() == 4
    assert [r["ordinal"] for r in select_records(df, 2, True).orderBy("ordinal").collect()] == [0, 2]
    with pytest.raises(ValueError, match="too short"):
        select_records(df, 4, True)
    nameless = df.drop("video")
    with pytest.raises(Exception, match="none of video_id"):
        evaluate(nameless, video_mode=True).frames.collect()


def test_callable(spark):
    fields = "ordinal long, video string, frame_index int, variant string, height int, width int, "
    planes = ", ".join(f"{s}{c} array<double>" for s in "st" for c in "rgb")
    flat = lambda x: [float(x)] * 16
    rows = [(i, "v", i, v, 4, 4, *(flat(0.25),) * 3, *(flat(0.5),) * 3) for i, v in enumerate("aab")]
    df = spark.createDataFrame(rows, fields + planes)
    scores = evaluate_with(df, lambda frame: np.kron(frame * 2, np.ones((1, 2, 2))), variants=["a"])
    found = scores.frames.collect()
    assert len(found) == 2 and all(r["psnr"] > 150 for r in found)
    assert {r["id"] for r in found} == {"v:0:a", "v:1:a"} and found[0]["category"] == "pgc"
    double = lambda frame: frame * 2
    assert evaluate_with(df, double, max_records=0).frames.count() == 0
    assert evaluate_with(df, double, max_records=2, subsample=2).frames.count() == 1
    grid = df.drop("variant").selectExpr("*", "'reinhard' AS tmo", "23 AS crf")
    assert evaluate_with(grid, double).frames.first()["variant"] == "reinhard_crf23"


def test_optional_scorers(spark):
    df = spark.createDataFrame([row(0, 0.3, 0.5), row(1, 0.3, 0.4)], SCHEMA)

    def gap(prediction, target):
        return np.abs(prediction - target).max()

    def missing():
        raise reduce.Unavailable("hdr_vdp3", "no tool")

    scores = evaluate(df, scorers={"hdr_lpips": gap, "hdr_vdp3": gap}, probes={"hdr_vdp3": missing})
    assert [r["hdr_lpips"] for r in scores.frames.orderBy("ordinal").collect()] == pytest.approx([0.2, 0.1])
    assert "hdr_vdp3" not in scores.frames.columns and scores.availability["hdr_vdp3"] == "no tool"
    assert scores.overall.where("variant = 'ALL'").first()["hdr_lpips"] == pytest.approx(0.15)
    with pytest.raises(ValueError, match="no such optional"):
        evaluate(df, scorers={"odd": gap})


def test_availability():
    calls = []

    def works():
        calls.append(1)

    def fails():
        raise reduce.Unavailable("hdr_vdp3", "no tool")

    found = reduce.availability({"hdr_lpips": works, "hdr_vdp3": fails})
    assert found["hdr_lpips"] is None and found["hdr_vdp3"] == "no tool" and calls == [1]
    assert found["fr_hidrovqa"] == "no backend is registered" and found["psnr"] is None
    assert found["flicker_raw"] == "requires video mode"
    assert "disabled" in reduce.availability(optional=False)["hdr_lpips"]


def test_report(spark, tmp_path):
    df = spark.createDataFrame([row(0, 0.3, 0.32, "a"), row(1, 0.31, 0.3, "a")], SCHEMA)
    write_report(evaluate(df, video_mode=True), str(tmp_path))
    read = lambda name: spark.read.option("header", True).csv(str(tmp_path / f"{name}.csv"))
    assert read("per_frame").count() == 2
    assert read("per_frame").first()["hdr_vdp3"] == "unavailable: no backend is registered"
    assert {r["metric"]: r["status"] for r in read("availability").collect()}["psnr"] == "available"
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "summary.md")).collect()]
    assert lines[0].startswith("| Variant | ") and lines[1].startswith("|---|")
    assert lines[2].startswith("| ALL | ") and any("- hdr_vdp3: unavailable" in x for x in lines)
    assert any("a / m" in r["value"] for r in spark.read.text(str(tmp_path / "per_video.md")).collect())


def test_describe(spark):
    rng = np.random.default_rng(0)
    planes = rng.random((3, 64))
    df = spark.createDataFrame(
        [(1, 8, 8, *(p.tolist() for p in planes))],
        "k int, height int, width int, r array<double>, g array<double>, b array<double>",
    )
    found = describe_frames(df, ["k"])
    y = np.array(found.maps.first()["luminance"])
    stats = found.stats.first()
    assert stats["mean_y"] == pytest.approx(y.mean()) and stats["std_y"] == pytest.approx(y.std(ddof=1))
    assert stats["p95_y"] == pytest.approx(np.quantile(y, 0.95))
    assert len(found.bands.first()["bands"]) == 8
    pooled = to_grid(found.maps, ["k"], 2, 2).first()["luminance"]
    assert pooled[0] == pytest.approx(y.reshape(8, 8)[:4, :4].mean())


def test_stabilise(spark):
    rows = [(1, n, [float(n)] * 8, [0.0] * 8, [0.5] * 9) for n in range(4)]
    params = spark.createDataFrame(rows, "video int, frame int, widths array<double>, heights array<double>, slopes array<double>")
    smoothed = {r["frame"]: r["widths"][0] for r in stabilise(params, 8).collect()}
    assert smoothed == pytest.approx({0: 0.0, 1: 0.2, 2: 0.56, 3: 1.048})
    pixels = spark.createDataFrame([(1, 2, 0.3, 0.4, 0.5)], "video int, frame int, r double, g double, b double")
    bent = apply_to_pixels(pixels, stabilise(params, 8), 8, strength=0.0).first()
    assert (bent["or"], bent["og"], bent["ob"]) == pytest.approx((0.3, 0.4, 0.5))


def test_stored_predictions_are_scored_again(spark, tmp_path):
    fields = "ordinal long, id string, video string, frame_index int, variant string, track string, height int, width int, "
    planes = ", ".join(f"{s}{c} array<double>" for s in "spt" for c in "rgb")
    dim, bright = pq_code_of(25), pq_code_of(50)
    flat = lambda x: [float(x)] * 64
    rows = [
        (i, f"r{i}", "v", i, "my / variant", "expert", 8, 8, *(flat(0.5),) * 3, *(flat(dim),) * 3, *(flat(bright),) * 3)
        for i in range(2)
    ]
    frames = spark.createDataFrame(rows, fields + planes)
    records = write_predictions(frames, str(tmp_path), "test")
    assert {r["prediction"] for r in records.collect()} == {
        f"predictions/{i:08d}_my_variant.png" for i in range(2)
    }
    assert (tmp_path / "inputs" / "00000001_my_variant.png").exists()
    loaded = load_predictions(spark, str(tmp_path / "predictions_manifest"), str(tmp_path))
    scores = evaluate(loaded, video_mode=True)
    found = scores.frames.orderBy("frame_index").collect()
    assert [r["id"] for r in found] == ["r0", "r1"]
    assert found[0]["exposure_gain"] == pytest.approx(2.0, rel=1e-3)
    assert found[0]["exposure_calibrated_psnr"] > found[0]["psnr"] + 20
    assert scores.videos.first()["flicker_raw"] == 0
