"""Corpora from tiny picture folders."""

import numpy as np
import pytest
from samples import ramp
from pyspark.sql import functions as F

from nitlake.plans.curate import curate, plan_source
from nitlake.plans.epoch import training_epoch
from nitlake.sources.files import conversion_inputs, list_files, reference_csv, video_hashes
from nitlake.sources.manifest import is_shard_manifest, read_header, read_manifest
from nitlake.sources.spec import Curation, from_mapping, from_yaml, source as made

HEX = ["%032x" % i for i in range(8)]


@pytest.fixture
def folders(tmp_path, put):
    for number, name in enumerate(("pgc", "ugc")):
        for frame in range(2):
            codes = np.rint(ramp(0.01 * (number + frame)) * 65535).astype(int)
            put(tmp_path / name / "scene" / f"frame_{frame:03d}.png", codes)
    return tmp_path


def sources(root):
    return [made({"name": n, "path": str(root / n)}) for n in ("pgc", "ugc")]


def test_grid_manifest_and_resume(spark, folders):
    cfg = Curation(sources=sources(folders)[:1], out_dir=str(folders / "out"), shard_bytes=20_000)
    records = curate(spark, cfg)
    assert records.columns == [
        "hdr_shard", "hdr_key", "sdr_shard", "sdr_key", "video",
        "frame", "tmo", "crf", "split", "source_dataset",
    ]
    rows = records.collect()
    assert len(rows) == 2 * 24 and len({r["sdr_key"] for r in rows}) == 48
    assert {r["hdr_shard"] for r in rows} == {"hdr-00000"}
    assert {r["sdr_shard"] for r in rows} == {"sdr-00000", "sdr-00001"}
    assert all(r["sdr_key"].startswith(f"sdr/{r['video']}/{r['frame']}/") for r in rows)

    again = curate(spark, Curation(**{**cfg.__dict__, "sources": sources(folders)}))
    merged = again.collect()
    assert len(merged) == 4 * 24
    old = {r["sdr_key"]: r for r in rows}
    assert all(old[r["sdr_key"]] == r for r in merged if r["sdr_key"] in old)
    assert {r["hdr_shard"] for r in merged} == {"hdr-00000", "hdr-00001"}

    written = f"{cfg.out_dir}/manifest-00001"
    assert is_shard_manifest(spark, f"{written}/records")
    assert read_header(spark, f"{written}/header").first()["hdr_mastering_peak_nits"] == 1000.0
    placed = read_manifest(spark, f"{written}/records", ordinal="ordinal").orderBy("ordinal")
    order = [(r["source_dataset"], r["video"], r["frame"], r["tmo"], r["crf"]) for r in placed.collect()]
    assert order == sorted(order)

    with pytest.raises(RuntimeError, match="luminance conventions"):
        curate(spark, Curation(**{**cfg.__dict__, "peak_nits": 500.0}))

    hdr = spark.read.parquet(f"{cfg.out_dir}/hdr")
    sdr = spark.read.parquet(f"{cfg.out_dir}/sdr")
    epoch = training_epoch(again, hdr, sdr, seed=1, epoch=0, batch=10, crop=8).collect()
    assert len(epoch) == 90
    assert all(len(r["sdr_r"]) == len(r["hdr_b"]) == 64 for r in epoch)
    assert all(0 <= min(r["sdr_r"]) and max(r["hdr_r"]) <= 1 for r in epoch)
    # The identity of HDR codes: PQ sources within the peak are kept.
    kept = hdr.where(F.col("run") == 0).orderBy("frame").first()
    assert np.array_equal(kept["r"], np.rint(np.minimum(ramp()[0], 1) * 65535).ravel().astype(int))


def test_expert_offset(spark, tmp_path, put):
    for frame, code in enumerate((1000, 2000, 3000)):
        put(tmp_path / "hdr" / "v" / f"{frame}.png", np.full((3, 4, 4), code))
    for frame, code in enumerate((11, 22)):
        put(tmp_path / "sdr" / "v" / f"{frame}.png", np.full((3, 4, 4), code), 8)
    source = made(
        {"name": "s", "path": str(tmp_path / "hdr"), "expert_sdr_path": str(tmp_path / "sdr"), "frame_offset": 1}
    )
    cfg = Curation(sources=[source], out_dir=str(tmp_path / "out"), tmos=["reinhard"], crf_levels=[23])
    records = curate(spark, cfg)
    expert = records.where("tmo = 'expert'").orderBy("frame").collect()
    assert [r["frame"] for r in expert] == [1, 2] and [r["crf"] for r in expert] == [None, None]
    sdr = spark.read.parquet(f"{cfg.out_dir}/sdr").where("tmo = 'expert'").orderBy("frame").collect()
    assert [r["r"][0] for r in sdr] == [11, 22]
    hdr = spark.read.parquet(f"{cfg.out_dir}/hdr").orderBy("frame").collect()
    assert [r["r"][0] for r in hdr] == [1000, 2000, 3000]


def test_native_pairs_keep_codes(spark, tmp_path, put):
    sdr = np.arange(8 * 9 * 3).reshape(3, 8, 9) % 256
    put(tmp_path / "hdr" / "a.png", sdr * 257)
    put(tmp_path / "sdr" / "a.png", sdr, 8)
    settings = {"name": "n", "path": str(tmp_path / "hdr"), "sdr_path": str(tmp_path / "sdr"), "mode": "native_pairs"}
    source = made(settings)
    cfg = Curation(sources=[source], out_dir=str(tmp_path / "out"))
    (row,) = curate(spark, cfg).collect()
    assert row["tmo"] == "native" and row["crf"] is None and row["sdr_key"].endswith("/0/native/none")
    (hdr,) = spark.read.parquet(f"{cfg.out_dir}/hdr").collect()
    assert np.array_equal(np.array(hdr["g"]).reshape(8, 9), sdr[1] * 257)

    put(tmp_path / "sdr" / "b.png", sdr, 8)
    with pytest.raises(ValueError, match=r"missing HDR=\['b.png'\]"):
        plan_source(spark, source)
    put(tmp_path / "bad" / "a.png", sdr, 8)
    bad = made({**settings, "path": str(tmp_path / "bad"), "sdr_path": str(tmp_path / "hdr")})
    with pytest.raises(Exception, match="8-bit codes, expected 16"):
        curate(spark, Curation(sources=[bad], out_dir=str(tmp_path / "out2")))


def test_selection_and_holdout(spark, tmp_path, put):
    for name in HEX:
        put(tmp_path / "hdr" / name / "0.png", np.full((3, 2, 2), 9))
    (tmp_path / "list.csv").write_text("Video,ref\n" + "".join(f"{h} ,{i % 2}\n" for i, h in enumerate(HEX)))
    settings = {"name": "s", "path": str(tmp_path / "hdr")}
    source = made(settings)
    assert [r["video"] for r in video_hashes(list_files(spark, source.path), "s").collect()] == HEX

    def videos(**change):
        plan = plan_source(spark, made({**settings, **change}))
        return sorted(r["video"] for r in plan.collect())

    listed = videos(reference_csv=str(tmp_path / "list.csv"))
    assert listed == HEX[1::2]
    both = videos(reference_csv=str(tmp_path / "list.csv"), include_video_hashes=HEX[:4])
    assert both == [HEX[1], HEX[3]]
    assert videos(exclude_video_hashes=HEX[:6]) == HEX[6:]
    fallback = reference_csv(spark, str(tmp_path / "list.csv"), filter_value="9")
    assert fallback.count() == 8
    held = videos(holdout_count=3)
    assert len(held) == 5 and held == videos(holdout_count=3)
    with pytest.raises(ValueError, match="9 are required"):
        videos(holdout_count=9)


def test_settings_are_checked(tmp_path):
    good = {"sources": [{"name": "a", "path": "x"}]}
    assert len(from_mapping(good).tmos) == 8
    for change, text in (
        ({"tmos": ["nope"]}, "unknown tone"),
        ({"tmos": ["reinhard", "reinhard"]}, "named twice"),
        ({"sources": [{"name": "a", "path": "x", "mode": "odd"}]}, "unknown source modes"),
        ({"sources": [{"name": "a", "path": "x", "frame_offset": -1}]}, "must not be negative"),
        ({"colour": 1}, "unknown settings"),
        ({"sources": [{"name": "a", "path": "x", "fps": 1}]}, "without effect"),
        ({"sources": [{"name": "a", "path": "x", "mode": "native_pairs"}]}, "needs sdr_path"),
    ):
        with pytest.raises(ValueError, match=text):
            from_mapping({**good, **change})


def test_yaml(tmp_path):
    path = tmp_path / "corpus.yaml"
    path.write_text("out_dir: out\nsources:\n  - {name: a, path: x, holdout_count: 10}\n")
    cfg = from_yaml(str(path))
    assert cfg.out_dir == "out" and cfg.sources[0].choice.held_out.count == 10 and cfg.sources[0].dataset == "a"


def test_strict_scan_and_kinds(spark, tmp_path, put):
    mixed = tmp_path / "manifest.jsonl"
    mixed.write_text('{"type": "header", "format": "x"}\n\n{"id": "1", "hdr": "a.png"}\n{"hdr_shard": "s"}\n')
    assert read_manifest(spark, str(mixed)).count() == 2
    assert read_header(spark, str(mixed)).first()["format"] == "x"
    assert not is_shard_manifest(spark, str(mixed))
    with pytest.raises(Exception, match="mixes shard records"):
        read_manifest(spark, str(mixed), strict=True).collect()
    for name in ("b.PNG", "a.png", "c.txt", "sub/d.png"):
        put(tmp_path / "in" / name, np.zeros((3, 1, 1)), 8)
    found = conversion_inputs(list_files(spark, str(tmp_path / "in")), 5)
    assert [r["relative"] for r in found.collect()] == ["a.png", "b.PNG"]


def test_other_pictures_are_refused_by_name(spark, tmp_path, put):
    put(tmp_path / "in" / "v" / "0.png", np.zeros((3, 1, 1)), 8)
    (tmp_path / "in" / "v" / "1.tiff").write_bytes(b"II*")
    with pytest.raises(NotImplementedError, match="1.tiff"):
        plan_source(spark, made({"name": "s", "path": str(tmp_path / "in")}))


def test_lines_are_numbered_in_small_blocks(spark, tmp_path, monkeypatch):
    """A split of more lines than a block: places as in the file, without headers and blank lines."""
    monkeypatch.setattr("nitlake.sources.manifest.LINES", 8)
    lines = ['{"type": "header"}', *(x for n in range(50) for x in (f'{{"video": "v{n}", "frame": {n}}}', "")[: 1 + n % 2])]
    (tmp_path / "m.jsonl").write_text("\n".join(lines))
    read = read_manifest(spark, str(tmp_path / "m.jsonl"), ordinal="ordinal")
    assert sorted((r.ordinal, r.frame) for r in read.collect()) == [(n, n) for n in range(50)]
