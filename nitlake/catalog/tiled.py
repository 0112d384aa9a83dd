"""Frames in tiles, whose side does not divide the frame's."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import codes, labels
from ..functions.common import num, round_to
from ..operators import frames as fr, tiles
from ..plans.epoch import stored_epoch
from ..session import shared_dir
from ..sources import tables
from . import ORACLES, query
from . import sqltext as q
from .frames import KEYS

SEED, EPOCH, BATCH, CROP, SIDE = 7, 3, 16, 6, 5


def _tiled(spark, folder, size=SIDE):
    frames = tables.frames(spark, folder).withColumn("dimmed", F.transform("plane", lambda c: c * num(0.9) + num(0.02)))
    return tiles.to_tiles(frames, KEYS, ["plane", "dimmed"], size)


def _pixels(tiled):
    spread = tiled.select(*KEYS, *tiles.GRID, F.posexplode("out").alias("i", "v"))
    across = F.least(F.col("tile"), F.col("width") - F.col("tile_column") * F.col("tile"))
    y, x = F.floor(F.col("i") / across), F.col("i") % across
    return spread.select(
        *KEYS,
        (F.col("tile_row") * F.col("tile") + y).cast("bigint").alias("y"),
        (F.col("tile_column") * F.col("tile") + x).cast("bigint").alias("x"),
        round_to(F.col("v"), 8).alias("value"),
    )


@query("tile_gradient", ORACLES["log_gradient"])
def tile_gradient(spark, folder):
    """The gradient, with one pixel of the tiles around."""
    found = tiles.log_gradient(_tiled(spark, folder), KEYS, "plane", "out")
    return _pixels(found)


@query("tile_ssim", ORACLES["pu21_ssim"])
def tile_ssim(spark, folder):
    """Similarity whose window reaches over two tiles."""
    found = tiles.ssim(_tiled(spark, folder), KEYS, "dimmed", "plane")
    return found.select(*KEYS, round_to(F.col("ssim"), 8).alias("ssim"))


@query("tile_bands", ORACLES["spectral_bands"])
def tile_bands(spark, folder):
    """The spectrum by rows, then by columns."""
    found = tiles.spectral_bands(_tiled(spark, folder), KEYS, "plane")
    return found.select(*KEYS, "band", round_to(F.col("energy"), 8).alias("energy"))


@query("tile_resize", ORACLES["bilinear_resize"])
def tile_resize(spark, folder):
    """Bilinear taps that lie in two tiles."""
    return _pixels(tiles.resized(_tiled(spark, folder), KEYS, "plane", 5, 11, size=4))


@query("tile_pool", ORACLES["grid_pool"])
def tile_pool(spark, folder):
    """Cells that overlap and reach over several tiles."""
    return _pixels(tiles.pooled(_tiled(spark, folder, 3), KEYS, "plane", 3, 3, size=2))


def _hash(tag):
    return "('0x'||substring(sha256('" + f"{SEED}:{EPOCH}{tag}" + "'||':'||sdr_key),1,12))::BIGINT"


_LEVELS = (("code", "1e0-code", "code*5e-1"), 65535), (("CASE WHEN crf IS NULL THEN code ELSE 1e0-code END", "code*5e-1", "code"), 255)
_CODES = ", ".join(
    f"round(round_even(({v})*{q.d(top)},0)/{q.d(top)},8) AS {side}_{c}"
    for side, (values, top) in zip(("hdr", "sdr"), _LEVELS)
    for c, v in zip("rgb", values)
)


@query(
    "training_epoch_rows",
    q.rows(
        q.PLANES,
        "r AS (SELECT DISTINCT video, frame, v.tmo, v.crf FROM planes, (VALUES ('reinhard',23),('expert',NULL)) AS v(tmo, crf)),"
        "k AS (SELECT *, 'sdr/'||video||'/'||frame||'/'||tmo||'/'||coalesce(crf::VARCHAR,'none') AS sdr_key FROM r)",
        q.epoch("k", "sdr_key", SEED, EPOCH, BATCH),
        f"w AS (SELECT *, {_hash(':top')} % {8 - CROP + 1} AS t,"
        f" {_hash(':left')} % {8 - CROP + 1} AS l, {_hash(':flip')}/{float(2**48)!r}::DOUBLE < 5e-1 AS flipped FROM placed)",
        select="SELECT batch_id, place, w.video||':'||w.frame AS id, CASE WHEN crf IS NULL THEN tmo ELSE tmo||'_crf'||crf END AS variant,"
        f" flipped, oy.y::BIGINT AS y, ox.x::BIGINT AS x, {_CODES} FROM w, range({CROP}) oy(y), range({CROP}) ox(x), planes p"
        f" WHERE p.video = w.video AND p.frame = w.frame AND p.y = w.t+oy.y AND p.x = w.l+(CASE WHEN flipped THEN {CROP - 1}-ox.x ELSE ox.x END)",
        recursive=True,
    ),
)
def training_epoch_rows(spark, folder):
    """An epoch of cut and flipped pairs, read from two tile stores in the shared folder."""
    planes = tables.frames(spark, folder)
    hdr = planes.withColumn("key", labels.hdr_key(F.col("video"), F.col("frame")))
    grid = F.array(*(F.struct(F.lit(t).alias("tmo"), F.lit(c).cast("int").alias("crf")) for t, c in (("reinhard", 23), ("expert", None))))
    sdr = planes.select("*", F.inline(grid))
    sdr = sdr.withColumn("key", labels.sdr_key(F.col("video"), F.col("frame"), F.col("tmo"), F.col("crf")))
    level = lambda f, top: F.transform("plane", lambda v: codes.quantise(f(v), top))
    same, turned, half = (lambda v: v), (lambda v: num(1) - v), (lambda v: v * num(0.5))
    first = F.when(F.col("crf").isNull(), level(same, codes.SDR_CODES)).otherwise(level(turned, codes.SDR_CODES))
    stores = {
        "hdr": hdr.withColumns({c: level(f, codes.HDR_CODES) for c, f in zip("rgb", (same, turned, half))}),
        "sdr": sdr.withColumns({"r": first, "g": level(half, codes.SDR_CODES), "b": level(same, codes.SDR_CODES)}),
    }
    place = f"{shared_dir(spark)}/epoch-{uuid.uuid4().hex}"
    for name, frames in stores.items():
        tiles.write_tiles(tiles.to_tiles(frames, ["key"], list("rgb"), SIDE), f"{place}/{name}", ["key"])
        stores[name] = spark.read.parquet(f"{place}/{name}")
    records = sdr.select(
        labels.hdr_key(F.col("video"), F.col("frame")).alias("hdr_key"), F.col("key").alias("sdr_key"),
        "video", "frame", "tmo", "crf", F.lit("train").alias("split"), F.lit("given").alias("source_dataset"),
    )
    epoch = stored_epoch(records, stores["hdr"], stores["sdr"], SEED, EPOCH, BATCH, CROP)
    names = [f"{side}_{c}" for side in ("hdr", "sdr") for c in "rgb"]
    pixels = fr.to_pixels(epoch, ["batch_id", "place", "id", "variant", "flipped"], {n: n for n in names})
    places = {n: F.col(n).cast("bigint") for n in ("y", "x")}
    return pixels.withColumns(places | {n: round_to(F.col(n), 8) for n in names})
