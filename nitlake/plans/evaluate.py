"""Scoring of predicted frames: frame rows, video rows, overall rows, availability."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.common import RGB, num, rgb
from ..functions.light import gained
from ..functions.spaces import PU21_PEAK, luma_2020, pu21_encode
from ..functions.transfer import pq_eotf_nits
from ..operators import flicker as flick
from ..operators import reduce
from ..operators.attach import attach
from ..operators.exposure import fit_gains
from ..operators.frames import bilinear, predict_frames, repack, spread_pixels, ssim_of_units, to_pixels
from ..operators.metrics import CORE_METRICS, OPTIONAL_METRICS, pixel_scores
from ..operators.models import Model, model_frames, model_scores
from ..operators.numbering import every_nth, first_rows, number_rows
from ..operators.select import too_short, variants_only
from ..session import stored

PLANES = {s + c: s + c for s in "pt" for c in "rgb"}


@dataclass
class Scores:
    """The four tables of an evaluation."""

    frames: DataFrame
    videos: DataFrame
    overall: DataFrame
    availability: dict[str, str | None]


def same_size(frames: DataFrame) -> DataFrame:
    """Predicted planes at the size of the target; only frames that differ are resized."""
    size = [F.col(n) for n in ("p_height", "p_width", "height", "width")]
    equal = (size[0] == size[2]) & (size[1] == size[3])
    resized = {f"p{c}": bilinear(F.col(f"p{c}"), *size) for c in "rgb"}
    both = frames.where(equal).unionByName(frames.where(~equal).withColumns(resized))
    return both.drop("p_height", "p_width")


def _units(side: str):
    """The plane of PU21 luminance over its peak of one side of a frame row."""
    zipped = F.arrays_zip(*(F.col(side + c).alias(c) for c in "rgb"))

    def one(p):
        nits = RGB(p["r"], p["g"], p["b"]).map(pq_eotf_nits)
        return pu21_encode(luma_2020(nits)) / num(PU21_PEAK)

    return F.transform(zipped, one)


def core_scores(frames: DataFrame) -> DataFrame:
    """One row per ``ordinal`` with the four core metrics.

    Means over pixels are reduced inside the task that holds the frame; similarity needs
    neighbours and works on the planes in place.
    """
    pixels = to_pixels(frames, ["ordinal"], PLANES)
    means = pixel_scores(pixels, ["ordinal"])
    alike = ssim_of_units(_units("p"), _units("t"), F.col("height"), F.col("width"))
    return means.join(frames.select("ordinal", alike.alias("ssim")), "ordinal")


def calibrated_scores(frames: DataFrame) -> DataFrame:
    """Gain and calibrated metrics per ``ordinal`` for frames of the expert track."""
    content = ["_content", "variant"]
    gains = fit_gains(to_pixels(frames, content, PLANES), content)
    joined = attach(frames, gains, content)
    zipped = F.arrays_zip(*(F.col("p" + c).alias(c) for c in "rgb"))
    lifted = F.transform(
        zipped,
        lambda p: F.struct(
            *(
                code.alias(c)
                for code, c in zip(
                    gained(RGB(p["r"], p["g"], p["b"]), F.col("exposure_gain")), "rgb"
                )
            )
        ),
    )
    moved = joined.withColumn("_lifted", lifted)
    moved = moved.withColumns({"p" + c: F.col("_lifted")[c] for c in "rgb"}).drop("_lifted")
    scores = core_scores(moved)
    renamed = scores.select(
        "ordinal", *(F.col(n).alias(f"exposure_calibrated_{n}") for n in CORE_METRICS)
    )
    return renamed.join(joined.select("ordinal", "exposure_gain"), "ordinal")


def optional_scores(frames: DataFrame, scorers: Mapping[str, Callable | Model]) -> DataFrame:
    """One row per ``ordinal`` with a column per scorer.

    A scorer takes prediction and target as (3, height, width) arrays and returns a number; a
    :class:`Model` takes arrays of many frames of one shape.
    """
    batched = {name: score for name, score in scorers.items() if isinstance(score, Model)}
    if batched:
        sides = [[s + c for c in "rgb"] for s in "pt"]
        found = model_scores(frames, ["ordinal"], batched, *sides)
        rest = {name: score for name, score in scorers.items() if name not in batched}
        return found.join(optional_scores(frames, rest), "ordinal") if rest else found
    schema = "ordinal bigint" + "".join(f", {name} double" for name in scorers)

    def run(batches):
        for batch in batches:
            rows = []
            for row in batch.to_dict("records"):
                shape = (int(row["height"]), int(row["width"]))
                sides = [
                    np.stack([np.asarray(row[s + c], float).reshape(shape) for c in "rgb"])
                    for s in "pt"
                ]
                scores = {name: float(score(*sides)) for name, score in scorers.items()}
                rows.append({"ordinal": row["ordinal"], **scores})
            yield pd.DataFrame(rows, columns=["ordinal", *scorers])

    return frames.select("ordinal", "height", "width", *PLANES).mapInPandas(run, schema)


def frame_flicker(frames: DataFrame) -> DataFrame:
    """Flicker per video and variant, frames in ``(frame_index, ordinal)`` order."""
    keep = ["video", "variant", "frame_index", "ordinal"]
    pixels = spread_pixels(frames, keep, PLANES)
    lit = pixels.withColumns(
        {
            "pred": pu21_encode(luma_2020(rgb("p").map(pq_eotf_nits))),
            "target": pu21_encode(luma_2020(rgb("t").map(pq_eotf_nits))),
        }
    )
    planes = repack(lit, keep, ["pred", "target"], "double").withColumn("_at", F.struct("frame_index", "ordinal"))
    keys = ["video", "variant"]
    return flick.flicker(flick.tile_transitions(planes, keys, "_at"), keys)


def _text(frames: DataFrame, name: str):
    return F.col(name).cast("string") if name in frames.columns else F.lit(None).cast("string")


def evaluate(
    frames: DataFrame,
    video_mode: bool = False,
    max_records: int | None = None,
    optional: bool = True,
    probes: Mapping[str, Callable[[], None]] | None = None,
    scorers: Mapping[str, Callable | Model] | None = None,
) -> Scores:
    """Score frame rows that hold a prediction and its target.

    ``scorers`` supplies optional metrics by name, see :func:`optional_scores`. One whose
    probe finds no backend is not called: its metric is null and its reason is reported.

    ``frames`` has ``ordinal`` (place in the manifest), ``height``, ``width``, ``p_height``,
    ``p_width``, planes ``pr pg pb tr tg tb`` of PQ codes, and any of the prediction fields
    ``id, content_id, video_id, video, sequence_id, frame_index, frame, variant, track, tmo,
    category``. A ``max_records`` of 0 is no cap.
    """
    if max_records:
        frames = of_names(frames, capped(frames.select("ordinal"), max_records))
    scorers = dict(scorers or {})
    unknown = sorted(set(scorers) - set(OPTIONAL_METRICS))
    if unknown:
        raise ValueError(f"no such optional metrics: {unknown}")
    probes = {**{name: lambda: None for name in scorers}, **(probes or {})}
    found = reduce.availability(probes, optional, video_mode)
    usable = {name: score for name, score in scorers.items() if found[name] is None}
    at = F.coalesce(_text(frames, "frame_index"), _text(frames, "frame"), F.col("ordinal"))
    variant = F.coalesce(_text(frames, "variant"), F.lit("precomputed"))
    row_id = F.coalesce(_text(frames, "id"), F.col("ordinal").cast("string"))
    names = [_text(frames, n) for n in ("video_id", "video", "sequence_id")]
    named = same_size(frames).select(
        "ordinal",
        "height",
        "width",
        *PLANES,
        row_id.alias("id"),
        labels.video_id(*names, row_id, required=video_mode).alias("video"),
        labels.content_id(_text(frames, "content_id"), *names, _text(frames, "id")).alias(
            "_content"
        ),
        at.cast("bigint").alias("frame_index"),
        variant.alias("variant"),
        F.coalesce(_text(frames, "category"), F.lit("verification")).alias("category"),
        labels.is_expert(_text(frames, "track"), _text(frames, "tmo"), variant).alias("_expert"),
    )
    expert = calibrated_scores(named.where("_expert"))
    plain = ["ordinal", "id", "video", "frame_index", "variant", "category", "_expert"]
    rows = named.select(*plain).join(core_scores(named), "ordinal")
    if usable:
        rows = rows.join(optional_scores(named, usable), "ordinal")
    rows = rows.join(expert, "ordinal", "left").withColumn(
        "headline_protocol",
        F.when(F.col("_expert"), "exposure_calibrated").otherwise("raw"),
    )
    rows = rows.drop("_expert")
    videos = reduce.per_video(
        rows, "ordinal", flicker=frame_flicker(named) if video_mode else None
    )
    return Scores(rows, videos, reduce.overall(videos), found)


#: Ordinals that are numbered in one task.
_BUCKET = 2**20


def capped(names: DataFrame, most: int) -> DataFrame:
    """The first ``most`` rows by ``ordinal``."""
    numbered = number_rows(names, ["ordinal"], (), [F.floor(F.col("ordinal") / _BUCKET)])
    return first_rows(numbered, "n", most).drop("n")


def of_names(frames: DataFrame, names: DataFrame) -> DataFrame:
    """Frames whose ``ordinal`` is among ``names``: choices are made on names, pictures come after."""
    return frames.join(names.select("ordinal"), "ordinal", "left_semi")


def select_records(records: DataFrame, subsample: int, video_mode: bool) -> DataFrame:
    """Every nth record by ``ordinal``, globally or per video; short videos are an error."""
    block = [F.floor(F.col("ordinal") / _BUCKET)]
    keys = ["video"] if video_mode else []
    kept = every_nth(number_rows(records, ["ordinal"], keys, block), "n", subsample).drop("n")
    if video_mode:
        short = [row["video"] for row in too_short(kept).limit(5).collect()]
        if short:
            raise ValueError(f"video mode needs two selected frames per video; too short: {short}")
    return kept


def evaluate_with(
    frames: DataFrame,
    predict: Callable | Model,
    variants: Sequence[str] | None = None,
    subsample: int = 1,
    video_mode: bool = False,
    max_records: int | None = None,
    **options,
) -> Scores:
    """Run ``predict`` (SDR frame to HDR frame) on every selected row and score the result.

    A :class:`Model` is loaded once a worker and runs on batches of frames of one shape.

    ``frames`` has SDR planes ``sr sg sb`` of height ``height`` and width ``width``, the
    target planes ``tr tg tb`` of the same size, and fields as for :func:`evaluate`; a
    variant that is not given is named after ``tmo`` and ``crf``. The first ``max_records``
    (0 is none) are subsampled, then filtered by variant; only then is anything predicted.
    """
    label = labels.variant_label(_text(frames, "tmo"), _text(frames, "crf"))
    named = frames.withColumn("variant", F.coalesce(_text(frames, "variant"), label))
    names = named.select(*(c for c, kind in named.dtypes if not kind.startswith("array")))
    if max_records is not None:
        names = capped(names, max_records)
    chosen = of_names(named, variants_only(select_records(names, subsample, video_mode), variants))
    at = F.coalesce(_text(named, "frame_index"), _text(named, "frame"), F.col("ordinal"))
    video = labels.video_id(
        *(_text(named, n) for n in ("video_id", "video", "sequence_id", "id")), required=False
    )
    chosen = chosen.withColumns(
        {
            "id": F.coalesce(
                _text(named, "id"), F.concat_ws(":", video, at.cast("string"), "variant")
            ),
            "category": F.coalesce(
                _text(named, "category"), _text(named, "source_dataset"), F.lit("pgc")
            ),
        }
    )
    planes, out = ("sr", "sg", "sb"), ("pr", "pg", "pb")
    run = model_frames if isinstance(predict, Model) else predict_frames
    predicted = run(chosen, predict, planes, out).drop(*planes)
    # The model runs once; scoring passes over its frames several times.
    predicted = stored(predicted, "predicted")
    sized = predicted.withColumnsRenamed({"out_height": "p_height", "out_width": "p_width"})
    return evaluate(sized, video_mode, **options)
