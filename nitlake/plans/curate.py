"""Curation of picture folders into a corpus of pairs.

Names are settled first: discovery, reference lists, holdouts and resume only touch paths.
Pictures are then decoded, normalised and degraded in their own partitions. A frame is
spread to pixels for the tone operators, which run in generated code, and put together
again from consecutive rows, so that no pixel is ever shuffled.
"""

from __future__ import annotations

from functools import reduce as fold

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes, labels
from ..functions.common import RGB, rgb
from ..functions.light import normalise
from ..functions.tone import tone_wide
from ..operators import pack, pair, select
from ..operators.codec import codec_loss
from ..operators.frames import repack, spread_pixels
from ..operators.numbering import first_rows, number_rows
from ..schemas import HEADER_FIELDS, SHARD_KEYS
from ..sinks.manifest import header_row, write_manifest
from ..sources import files, manifest, png
from ..sources.spec import Choice, Curation, Source

PLAN = ("source_dataset", "split", "video", "frame", "path", "sdr_path", "expert_path")


def _names(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "video string")


def _allowed(spark: SparkSession, choice: Choice) -> DataFrame | None:
    listed = included = None
    if choice.listed is not None:
        held = choice.listed
        listed = files.reference_csv(spark, held.path, held.column, held.flag, held.value)
    if choice.only is not None:
        included = _names(spark, list(choice.only))
    return select.both_lists(listed, included)


def _readable(found: DataFrame, name: str) -> DataFrame:
    """Only PNG is decoded; anything else is refused by name, before a task meets it."""
    if not found.where(F.col("kind") == "video").isEmpty():
        raise NotImplementedError(f"{name} holds video containers; decode them to pictures first")
    pictures = found.where(F.col("kind") == "image")
    other = pictures.where(~F.lower("relative").endswith(".png")).select("relative").orderBy("relative").limit(5).collect()
    if other:
        raise NotImplementedError(f"{name} holds pictures other than PNG: {[r['relative'] for r in other]}")
    return pictures


def plan_source(spark: SparkSession, source: Source, holdout: bool = True) -> DataFrame:
    """The frames of one source as a table of names (columns of ``PLAN``)."""
    if source.natives is not None:
        return _plan_native(spark, source)
    choice = source.choice
    found = files.discover(files.list_files(spark, source.path), F.lit(source.name))
    frames = files.sequences(_readable(found, source.name))
    frames = first_rows(frames, "frame", choice.frames)
    frames = select.allowed_only(frames, _allowed(spark, choice))
    if choice.never:
        frames = select.without(frames, _names(spark, list(choice.never)))
    if holdout and choice.held_out is not None:
        frames = frames.withColumn("_source", F.lit(source.name))
        videos = frames.select("_source", "video").distinct()
        select.enough(videos, "_source", choice.held_out.count)
        held = select.drawn(videos, "_source", "video", choice.held_out.count, choice.held_out.seed)
        frames = select.without(frames, held)
    expert = F.lit(None).cast("string")
    if source.experts is not None:
        listed = files.list_files(spark, source.experts.path)
        frames = pair.expert_match(frames, listed.select("relative", F.col("path").alias("expert")))
        expert = F.col("expert")
    plan = frames.select(
        F.lit(source.dataset).alias("source_dataset"),
        F.lit(source.split).alias("split"),
        "video",
        F.col("frame").cast("int").alias("frame"),
        "path",
        F.lit(None).cast("string").alias("sdr_path"),
        expert.alias("expert_path"),
    )
    if source.experts is None:
        return plan
    slots = plan.select("video", "frame", F.col("expert_path").alias("expert"))
    paired = pair.offset_pairs(plan.select("video", "frame"), slots, source.experts.offset)
    renamed = paired.select("video", "frame", F.col("expert").alias("expert_path"))
    return plan.drop("expert_path").join(renamed, ["video", "frame"], "left").select(*PLAN)


def _plan_native(spark: SparkSession, source: Source) -> DataFrame:
    def side(folder: str, name: str) -> DataFrame:
        listed = files.list_files(spark, folder)
        kept = _readable(listed.withColumn("kind", files.kind_of(F.col("relative"))), source.name)
        return kept.select("relative", F.col("path").alias(name))

    hdr, sdr = side(source.path, "path"), side(source.natives.path, "sdr_path")
    if hdr.isEmpty():
        raise ValueError(f"no supported pictures in {source.path}")
    lost = pair.native_mismatch(hdr, sdr)
    shown = {
        name: [r["relative"] for r in lost.where(F.col("missing") == name)
               .orderBy("relative").limit(5).collect()]
        for name in ("sdr", "hdr")
    }
    if any(shown.values()):
        raise ValueError(
            f"names of {source.name} do not match: missing SDR={shown['sdr']}, "
            f"missing HDR={shown['hdr']}"
        )
    pairs = pair.native_pairs(hdr, sdr).withColumn("source_dataset", F.lit(source.dataset))
    drawn = source.natives.drawn
    if drawn is not None:
        select.enough(pairs, "source_dataset", drawn.count)
        chosen = select.drawn(pairs, "source_dataset", "relative", drawn.count, drawn.seed, "native_pairs")
        pairs = pairs.join(chosen, ["source_dataset", "relative"], "left_semi")
    return pairs.select(
        "source_dataset",
        F.lit(source.split).alias("split"),
        labels.stable_hash(F.lit(source.name), F.col("relative")).alias("video"),
        F.lit(0).alias("frame"),
        "path",
        "sdr_path",
        F.lit(None).cast("string").alias("expert_path"),
    )


def _decoded(names: DataFrame, path: str, depth: int | None) -> DataFrame:
    """Pictures of the planned frames that have one in the column ``path``."""
    wanted = names.where(F.col(path).isNotNull()).select(
        "source_dataset", "split", "video", "frame", F.col(path).alias("_file")
    )
    return png.decode_named(wanted, {"": "_file"}, depth).drop("_file")


def hdr_frames(source: Source, plan: DataFrame, peak: float) -> DataFrame:
    """Normalised HDR frames as 16-bit planes; native frames keep their codes."""
    if source.natives is not None:
        return _decoded(plan, "path", 16).drop("depth")
    frames = png.as_signal(_decoded(plan, "path", None)).drop("depth")
    keys = ["source_dataset", "split", "video", "frame", "height", "width"]
    pixels = spread_pixels(frames, keys, {c: c for c in "rgb"})
    normal: RGB = normalise(rgb(""), source.signal, peak)
    coded = pixels.withColumns(
        {c: codes.quantise(v, codes.HDR_CODES) for c, v in zip("rgb", normal)}
    )
    return repack(coded, keys, list("rgb"))


def degraded_frames(hdr: DataFrame, tmos: list[str], crfs: list[int], peak: float) -> DataFrame:
    """SDR frames of the whole grid from HDR frames of 16-bit planes."""
    keys = ["source_dataset", "split", "video", "frame", "height", "width"]
    pixels = spread_pixels(hdr, keys, {c: c for c in "rgb"})
    signal = pixels.withColumns({c: codes.scale(F.col(c), codes.HDR_CODES) for c in "rgb"})
    wide = tone_wide(signal, tmos, peak=peak)
    names = [f"{tmo}_{c}" for tmo in tmos for c in "rgb"]
    coded = wide.select(
        "_row",
        "_count",
        *keys,
        *(codes.quantise(F.col(n), codes.SDR_CODES).alias(n) for n in names),
    )
    frames = repack(coded, keys, names)
    entries = F.array(
        *(
            F.struct(
                F.lit(tmo).alias("tmo"),
                F.lit(int(crf)).alias("crf"),
                *(F.col(f"{tmo}_{c}").alias(c) for c in "rgb"),
            )
            for tmo in tmos
            for crf in crfs
        )
    )
    return codec_loss(frames.select(*keys, F.inline(entries)))


def _written(spark: SparkSession, read, *args, **options) -> DataFrame | None:
    try:
        return read(spark, *args, **options)
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def check_header(spark: SparkSession, folder: str, peak: float) -> None:
    """A corpus of other conventions must not be continued."""
    actual = _written(spark, manifest.read_header, f"{folder}/header")
    if actual is None or actual.isEmpty():
        raise RuntimeError(f"cannot resume a manifest without a header: {folder}")
    wrong = pair.header_mismatch(actual, header_row(spark, peak), HEADER_FIELDS).collect()
    if wrong:
        listed = {r["field"]: (r["actual"], r["expected"]) for r in wrong}
        raise RuntimeError(f"cannot resume with other luminance conventions: {listed}")


def _shards(frames: DataFrame, kind: str, per_sample: int, first, target: int) -> DataFrame:
    """Shard name of every storage key, from sizes alone."""
    nbytes = (F.col("height") * F.col("width") * 3 * per_sample).cast("bigint")
    items = frames.select("key", nbytes.alias("nbytes"))
    numbered = number_rows(items, ["key"], out="ordinal")
    dealt = pack.with_writers(numbered, "ordinal", "nbytes", target)
    final = pack.renumber(pack.pack(dealt, "ordinal", "nbytes", target), first)
    name = F.concat(F.lit(f"{kind}-"), labels.padded(F.col("final_shard"), 5))
    return final.select(F.col("key").alias(f"{kind}_key"), name.alias(f"{kind}_shard"))


def curate(spark: SparkSession, cfg: Curation) -> DataFrame:
    """Bring the corpus in ``cfg.out_dir`` up to its sources and return its manifest.

    Videos that the manifest has are skipped, whatever variants they have. Frames go to
    ``hdr`` and ``sdr`` (planes by storage key, one folder per run), names to ``manifest``.
    A run that breaks off before its manifest is written leaves only a run folder that no
    record names, and the next run replaces it.
    """
    cfg.check()
    out = cfg.out_dir
    existing = _written(spark, manifest.read_manifest, f"{out}/manifest*/records", strict=True)
    done, run, used = None, 0, None
    if existing is not None and not existing.isEmpty():
        latest = _latest(spark, out)
        check_header(spark, f"{out}/manifest-{latest:05d}", cfg.peak_nits)
        done = manifest.read_manifest(spark, f"{out}/manifest-{latest:05d}/records", strict=True)
        used, run = done, latest + 1
    hdr_parts, sdr_parts = [], []
    for source in (s for s in cfg.sources if s.enabled):
        plan = plan_source(spark, source)
        plan = select.without(plan, None if done is None else done.select("video").distinct())
        hdr = hdr_frames(source, plan, cfg.peak_nits)
        label = "native" if source.natives is not None else None
        hdr_parts.append((source, plan, hdr, label))
    if not hdr_parts:
        raise ValueError("no source is enabled")
    hdr_folder, sdr_folder = f"{out}/hdr/run={run}", f"{out}/sdr/run={run}"

    tagged = [hdr.withColumn("native", F.lit(label is not None)) for _, _, hdr, label in hdr_parts]
    every = fold(DataFrame.unionByName, tagged)
    every = every.withColumn("key", labels.hdr_key(F.col("video"), F.col("frame")))
    every.write.mode("overwrite").parquet(hdr_folder)
    # From here on frames are read from what was written; nothing is decoded twice.
    stored = spark.read.parquet(hdr_folder)

    derived = stored.where(~F.col("native")).drop("native", "key")
    sdr_parts.append(degraded_frames(derived, cfg.tmos, cfg.crf_levels, cfg.peak_nits))
    for source, plan, _, label in hdr_parts:
        given = [("sdr_path", label)] if label else []
        if source.experts is not None and not label:
            given.append(("expert_path", "expert"))
        for column, tmo in given:
            pictures = _decoded(plan, column, 8).drop("depth")
            sdr_parts.append(
                pictures.withColumns(
                    {"tmo": F.lit(tmo), "crf": F.lit(None).cast("int")}
                )
            )
    keyed = fold(DataFrame.unionByName, sdr_parts).withColumn(
        "key", labels.sdr_key(F.col("video"), F.col("frame"), F.col("tmo"), F.col("crf"))
    )
    keyed.write.mode("overwrite").parquet(sdr_folder)
    variants = spark.read.parquet(sdr_folder)

    def first(kind: str):
        if used is None:
            return F.lit(0).cast("bigint")
        return pack.next_shard(used, f"{kind}_shard", kind).scalar()

    sizes = stored.select(
        F.col("key").alias("hdr_key"),
        F.col("height").alias("hdr_height"),
        F.col("width").alias("hdr_width"),
    )
    records = variants.select(
        *("video", "frame", "tmo", "crf", "split", "source_dataset"),
        F.col("key").alias("sdr_key"),
        labels.hdr_key(F.col("video"), F.col("frame")).alias("hdr_key"),
        F.col("height").alias("sdr_height"),
        F.col("width").alias("sdr_width"),
    )
    records = pair.must_match(records.join(sizes, "hdr_key"))
    records = records.join(_shards(stored, "hdr", 2, first("hdr"), cfg.shard_bytes), "hdr_key")
    records = records.join(_shards(variants, "sdr", 1, first("sdr"), cfg.shard_bytes), "sdr_key")
    fresh = records.select(*SHARD_KEYS, "video", "frame", "tmo", "crf", "split", "source_dataset")
    merged = fresh if done is None else done.unionByName(fresh)
    target = f"{out}/manifest-{run:05d}"
    write_manifest(merged, target, header_row(spark, cfg.peak_nits))
    return manifest.read_manifest(spark, f"{target}/records")


def _latest(spark: SparkSession, out: str) -> int:
    """Highest number among the written manifests; there is one folder per run."""
    paths = spark.read.text(f"{out}/manifest*/header").select("_metadata.file_path").distinct()
    number = F.regexp_extract("file_path", r"/manifest-([0-9]+)/", 1).cast("int")
    return paths.agg(F.max(number)).first()[0]
