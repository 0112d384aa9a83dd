"""Draws for training: balanced records, shuffled epochs, cuts, flips and shared noise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import draws
from .attach import attach
from .numbering import number_rows
from .permute import permuted


def balanced_draw(
    records: DataFrame,
    category: str,
    record: str,
    seed: int,
    buckets: Sequence[Column] | None = None,
) -> DataFrame:
    """As many draws as there are records: a category at random, then a record of it.

    Every category is drawn equally often however many records it has. With a single one
    there is nothing to balance, and every record is taken once. ``buckets`` help number
    the records of a category, as in :func:`number_rows`.
    """
    numbered = number_rows(records, [record], [category], buckets, out="_place")
    counts = records.groupBy(category).agg(F.count(F.lit(1)).alias("_size"))
    ranked = number_rows(counts, [category], buckets=[F.substring(category, 1, 1)], out="_rank")
    many = counts.agg(F.count(F.lit(1))).scalar()
    size = records.sparkSession.range(records.count()).withColumnRenamed("id", "draw")
    first = draws.below(draws.ticket(f"{seed}:category", F.col("draw")), many)
    drawn = attach(size.withColumn("_rank", first), ranked, ["_rank"])
    second = draws.below(draws.ticket(f"{seed}:record", F.col("draw")), F.col("_size"))
    placed = F.when(many == 1, F.col("draw")).otherwise(second)
    chosen = drawn.withColumn("_place", placed).drop("_rank", "_size")
    return chosen.join(numbered, [category, "_place"]).drop("_place")


def drawn_key(variants: Column, drawn: Column) -> Column:
    """One key of a variant map, from its keys in order."""
    keys = F.array_sort(F.map_keys(variants))
    return F.get(keys, (drawn % F.size(keys)).cast("int"))


def ordinals(records: DataFrame, ids: Sequence[str], out: str = "ordinal") -> DataFrame:
    """Number records 0, 1, 2, ... by a keyed hash of ``ids``, which tell them apart.

    Made once for a corpus and kept with it: the orders of all epochs follow from these numbers. The
    leading bits of the hash spread records evenly over the buckets in which they are numbered.
    """
    ticketed = records.withColumn("_t", draws.ticket("ordinal", *(F.col(name) for name in ids)))
    return number_rows(ticketed, ["_t", *ids], buckets=[F.shiftright("_t", 32)], out=out).drop("_t")


def epoch_batches(
    records: DataFrame,
    ids: Sequence[str],
    seed: int,
    epoch: int,
    batch: int,
    ordinal: str | None = None,
    batches: tuple[int, int] | None = None,
) -> DataFrame:
    """Shuffled batches ``batch_id`` of exactly ``batch`` records; the rest is left out.

    A record's place follows from its number in ``ordinal`` by a keyed permutation, so an epoch
    sorts and shuffles nothing. Without ``ordinal`` records are numbered here, by :func:`ordinals`,
    and come in the same batches. ``batches`` takes the batches from the first number up to the
    second, not included: their places say which numbers they need, and only these records are placed.
    """
    if batch < 1:
        raise ValueError("a batch has at least one record")
    key, size = f"{seed}:{epoch}", records.count()
    numbered = records if ordinal else ordinals(records, ids, "_ordinal")
    number, whole = ordinal or "_ordinal", size // batch
    if batches is None:
        placed = permuted(numbered, number, size, key, "_n")
    else:
        first, last = max(batches[0], 0), min(batches[1], whole)
        places = records.sparkSession.range(first * batch, max(last, first) * batch).withColumnRenamed("id", "_n")
        wanted = permuted(places, "_n", size, key, number, inverse=True) if first < last else places.withColumn(number, F.col("_n"))
        placed = attach(numbered, wanted, [number])
    placed = placed.withColumns(
        {"batch_id": F.floor(F.col("_n") / F.lit(batch)), "place": F.col("_n") % F.lit(batch)}
    )
    return placed.where(F.col("batch_id") < whole).drop("_n", "_ordinal")


def collate(batches: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per batch with a list per column in batch order; a batch bounds the lists."""
    packed = F.array_sort(F.collect_list(F.struct("place", *columns))).alias("_rows")
    grouped = batches.groupBy("batch_id").agg(packed)
    # A field of an array of structs is the array of that field.
    return grouped.select("batch_id", *(F.col("_rows")[c].alias(c) for c in columns))


def shared_noise(pixels: DataFrame, seed: int, video: str = "video") -> DataFrame:
    """Add ``noise_r/g/b``: standard normal, one realisation per video for all its frames."""
    place = (F.col(video), F.col("y"), F.col("x"))
    return pixels.withColumns(
        {
            f"noise_{c}": draws.normal(
                draws.ticket(f"{seed}:{c}:a", *place), draws.ticket(f"{seed}:{c}:b", *place)
            )
            for c in "rgb"
        }
    )


def bridge_pairs(
    df: DataFrame, hdr: str, sdr: str, noise: str, time: str, strength: float
) -> DataFrame:
    """Add ``z_t`` on the way from HDR to noisy SDR at ``time`` and the velocity ``target``."""
    t = F.col(time)
    df = df.withColumn(
        "_start", F.zip_with(sdr, noise, lambda a, b: a + F.lit(float(strength)) * b)
    )
    return df.withColumns(
        {
            "z_t": F.zip_with(hdr, "_start", lambda a, b: (F.lit(1.0) - t) * a + t * b),
            "target": F.zip_with(hdr, "_start", lambda a, b: b - a),
        }
    ).drop("_start")
