"""One epoch of training pairs from a curated corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes, draws, labels
from ..operators import frames as fr, tiles
from ..operators.attach import attach
from ..operators.pair import must_match
from ..operators.sampling import epoch_batches
from ..session import cut


def training_epoch(
    records: DataFrame,
    hdr: DataFrame,
    sdr: DataFrame,
    seed: int,
    epoch: int,
    batch: int,
    crop: int | None = 512,
    flip: bool = True,
    ordinal: str | None = None,
) -> DataFrame:
    """Shuffled batches of cut, flipped and scaled pairs.

    ``records`` is a manifest; ``hdr`` and ``sdr`` hold integer planes ``r g b`` by ``key``.
    Records are shuffled and batched while they are only names. Cut and flip are drawn per
    record, the same for both sides, so frames are cut where they are read: an SDR frame by its
    own key, an HDR frame once for every record that wants it. Only cuts are joined. ``ordinal``
    is a column of numbers that :func:`ordinals` gave the records once.
    """
    chosen = epoch_batches(records, ["sdr_key"], seed, epoch, batch, ordinal)
    ticket = lambda tag: draws.ticket(f"{seed}:{epoch}:{tag}", F.col("sdr_key"))
    flipped = F.lit(flip) & (draws.uniform(ticket("flip")) < 0.5)

    def side(frames: DataFrame, name: str) -> DataFrame:
        planes = [F.col(c).alias(f"{name}_{c}") for c in "rgb"]
        size = [F.col(n).alias(f"{name}_{n}") for n in ("height", "width")]
        return frames.select(F.col("key").alias(f"{name}_key"), *size, *planes)

    def taken(frames: DataFrame, name: str, top: int) -> DataFrame:
        h, w = F.col(f"{name}_height"), F.col(f"{name}_width")
        planes = {f"{name}_{c}": F.col(f"{name}_{c}") for c in "rgb"}
        side_h, side_w = (F.lit(crop), F.lit(crop)) if crop else (h, w)
        if crop:
            at = fr.crop_offset(ticket("top"), h, crop), fr.crop_offset(ticket("left"), w, crop)
            planes = {n: fr.crop(p, h, w, *at, crop) for n, p in planes.items()}
        turned = {n: F.when(flipped, fr.mirrored(p, side_h, side_w)).otherwise(p) for n, p in planes.items()}
        return frames.withColumns({n: _scaled(p, top) for n, p in turned.items()})

    # A frame is wanted by as many records as it has variants.
    wants = chosen.groupBy("hdr_key").agg(F.collect_list("sdr_key").alias("_wants"))
    wanted = attach(side(hdr, "hdr"), wants, ["hdr_key"])
    wanted = wanted.withColumn("sdr_key", F.explode("_wants")).drop("_wants", "hdr_key")
    pairs = chosen.join(taken(side(sdr, "sdr"), "sdr", codes.SDR_CODES), "sdr_key")
    pairs = must_match(pairs.join(taken(wanted, "hdr", codes.HDR_CODES), "sdr_key"))
    pairs = pairs.withColumn("flipped", flipped)
    side_h, side_w = (F.lit(crop), F.lit(crop)) if crop else (F.col("sdr_height"), F.col("sdr_width"))
    return _batched(pairs, side_h, side_w)


def stored_epoch(
    records: DataFrame,
    hdr: DataFrame,
    sdr: DataFrame,
    seed: int,
    epoch: int,
    batch: int,
    crop: int = 512,
    flip: bool = True,
    batches: tuple[int, int] | None = None,
    ordinal: str | None = None,
) -> DataFrame:
    """:func:`training_epoch` from tile stores of integer planes ``r g b`` by ``key``: the same rows.

    Sizes are read from first tiles alone, cuts are drawn from them, and only tiles that a cut meets
    are joined. ``batches`` takes the batches from the first number up to the second, not included:
    a loader that asks for a few at a time has its keys and places pushed to the scan. Records whose
    frames are not stored have no row; a pair whose sides differ in size is an error.
    """
    chosen = cut(epoch_batches(records, ["sdr_key"], seed, epoch, batch, ordinal, batches))
    ticket = lambda tag: draws.ticket(f"{seed}:{epoch}:{tag}", F.col("sdr_key"))
    sized = chosen
    for name, store in (("hdr", hdr), ("sdr", sdr)):
        sizes = tiles.frame_sizes(store, ["key"]).drop("tile")
        sized = sized.join(sizes.toDF(f"{name}_key", f"{name}_height", f"{name}_width"), f"{name}_key")
    at = {n: fr.crop_offset(ticket(n), F.col(f"sdr_{s}"), crop) for n, s in (("top", "height"), ("left", "width"))}
    drawn = cut(must_match(sized).withColumns(at | {"flipped": F.lit(flip) & (draws.uniform(ticket("flip")) < 0.5)}))

    pairs, side = drawn.drop("top", "left"), F.lit(crop)
    for name, store, top in (("sdr", sdr, codes.SDR_CODES), ("hdr", hdr, codes.HDR_CODES)):
        windows = drawn.select("sdr_key", F.col(f"{name}_key").alias("key"), "top", "left", "flipped")
        found = tiles.crops(store, ["key"], windows, ["sdr_key", "flipped"], list("rgb"), crop)
        units = [fr.turned_units(c, side, side, "flipped", F.lit(top)).alias(f"{name}_{c}") for c in "rgb"]
        pairs = pairs.join(found.select("sdr_key", *units), "sdr_key")
    return _batched(pairs, side, side)


def _batched(pairs: DataFrame, side_h, side_w) -> DataFrame:
    planes = [f"{name}_{c}" for name in ("sdr", "hdr") for c in "rgb"]
    row_id = F.concat_ws(":", "video", F.col("frame").cast("string"))
    label = labels.variant_label(F.col("tmo"), F.col("crf"))
    return pairs.select(
        "batch_id",
        "place",
        row_id.alias("id"),
        label.alias("variant"),
        *("video", "frame", "tmo", "crf", "split", "source_dataset", "flipped"),
        side_h.alias("height"),
        side_w.alias("width"),
        *planes,
    )


def _scaled(plane, top: int):
    return F.transform(plane, lambda v: codes.scale(v, top))
