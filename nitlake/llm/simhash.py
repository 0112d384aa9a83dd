"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments. If two fingerprints differ in at most ``radius`` bits, then in
at least one segment they differ in no more bits than that segment's own radius, where the
segments' radii plus one add up to ``radius + 1``. So every fingerprint is filed under the exact
value of each segment, and looks up the small Hamming ball around each of its own values; what it
finds is verified on all 64 bits.

Equal fingerprints are one row from the start. A bucket that many fingerprints are filed under
(a cluster of near copies) is not joined but compared in blocks, of which only a spanning forest
of the links found is written. Both ways find every link.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import by_key, shared_dir, stored
from .components import components
from .words import column, mixed

SEED = 42
#: Up to this many fingerprints in a bucket are joined; larger buckets are compared in blocks.
JOINED = 128
#: Fingerprints of a hot bucket that one block holds.
BLOCK = 4096
#: From this many fingerprints on two segments are cheaper than three. Links are the same.
FEW = 1 << 24


def shingle_hashes(text: bytes, k: int) -> list[int]:
    """XXH64 of every run of ``k`` words of the A-Z lower-cased text, repeats included."""
    words = text.lower().split()  # of bytes: ASCII letters, and the six white characters
    if not words:
        return []
    line = b" ".join(words)
    cuts = [-1, *np.flatnonzero(np.frombuffer(line, np.uint8) == 32).tolist(), len(line)]
    digest = xxhash.xxh64_intdigest
    if len(words) <= k:
        return [digest(line, SEED)]
    return [digest(line[i + 1 : j], SEED) for i, j in zip(cuts, cuts[k:], strict=False)]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One fingerprint per text: the bits set in over half of its hashes. No hash: zero.

    Sixteen-bit lanes count four bits at once, over runs short enough not to overflow.
    """
    out = np.zeros(len(counts), np.uint64)
    if not len(hashes):
        return out
    ends = np.cumsum(counts)
    starts = ends - counts
    runs = np.unique(np.concatenate([starts[counts > 0], *(np.arange(s, e, 60_000) for s, e in zip(starts, ends, strict=True) if e - s > 60_000)]))
    text = np.searchsorted(ends, runs, side="right")
    lane = np.uint64(0x0001000100010001)
    for bit in range(16):
        sums = np.add.reduceat((hashes >> np.uint64(bit)) & lane, runs)
        for part in range(4):
            ones = (sums >> np.uint64(16 * part)) & np.uint64(0xFFFF)
            total = np.bincount(text, ones, len(counts)).astype(np.int64)
            out |= (2 * total > counts).astype(np.uint64) << np.uint64(bit + 16 * part)
    return out


def _fingerprints(k: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column(batch, "_text")
            held = data.tobytes()
            made, counts, prints, size = [], [], [], 0
            for i in range(len(offsets) - 1):
                found = shingle_hashes(held[offsets[i] : offsets[i + 1]], k)
                made.append(np.array(found, np.uint64))
                counts.append(len(found))
                size += len(found)
                if size > 500_000 or i == len(offsets) - 2:
                    hashes, each = np.concatenate(made), np.array(counts, np.int64)
                    # The first word is of the hashes themselves, others of what mixing makes of them.
                    prints.append([majority(mixed(hashes + np.uint64(w)) if w else hashes, each) for w in range(words)])
                    made, counts, size = [], [], 0
            parts = zip(*prints, strict=True) if prints else [[np.zeros(0, np.uint64)]] * words
            bits = [pa.array(np.concatenate(p).view(np.int64)) for p in parts]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *bits], names=["_id", *(f"w{i}" for i in range(words))])

    return run


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = 4, words: int = 1) -> DataFrame:
    """(_id, w0, w1, ...): 64 bits in each word, the SimHash over ``k``-word shingles of every whole text."""
    rows = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(_fingerprints(k, words), f"_id {kind}, " + ", ".join(f"w{i} bigint" for i in range(words)))


def _key(bits: Column, at: int, shift: int, width: int) -> Column:
    value = F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << width) - 1))
    return value.bitwiseOR(F.lit(at << 40))


def _forest(frame: pd.DataFrame, words: list[str], distance: int) -> pd.DataFrame:
    """Links that join the block's fingerprints as all their links of at most ``distance`` bits do."""
    node = frame["node"].to_numpy()
    bits = frame[words].to_numpy().view(np.uint64)
    left = np.argsort(node)
    a, b = [], []
    while len(left):
        root, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            near = np.bitwise_count(bits[left] ^ bits[queue.pop()]).sum(1) <= distance
            if near.any():
                found = left[near]
                left = left[~near]
                queue.extend(found)
                a.append(np.full(len(found), node[root]))
                b.append(node[found])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    return pd.DataFrame({"a": a, "b": b})


def links(prints: DataFrame, distance: int, segments: list[tuple[str, int, int, int]]) -> DataFrame:
    """(a, b) that connect just those rows (node, and words of bits) which links of at most ``distance``
    differing bits connect, as far as they meet in a segment: (word, shift, width, own radius) each.

    Rows are filed under the exact value of each segment and look up all values in its radius. What
    meets is verified on all words."""
    words = [c for c in prints.columns if c != "node"]
    # A row per segment, then a row per flip: a few dozen expressions however many keys they make.
    parts = F.array(
        *(
            F.struct(_key(F.col(word), i, shift, width).alias("key"), F.lit(1 << width).cast("bigint").alias("top"), F.lit(own).alias("own"))
            for i, (word, shift, width, own) in enumerate(segments)
        )
    )
    widest, most = max(width for *_, width, _ in segments), max(own for *_, own in segments)
    flips = [sum(1 << bit for bit in f) for r in range(most + 1) for f in combinations(range(widest), r)]
    homes = prints.select("node", *words, F.inline(parts)).drop("top", "own")
    few = len(words) == 1  # one word travels with its row; more are joined to what has met
    carried = ["node", *(words if few else [])]
    spread = prints.select(*carried, F.inline(parts)).select(
        *carried, "key", "top", "own", F.explode(F.array(*(F.lit(f).cast("bigint") for f in flips))).alias("flip")
    )
    inside = (F.col("flip") < F.col("top")) & (F.bit_count("flip") <= F.col("own"))
    probes = spread.where(inside).select(*carried, F.col("key").bitwiseXOR(F.col("flip")).alias("key"))
    hot = stored(homes.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > JOINED), "hot")
    # No hint: Spark broadcasts the hot keys where their size allows, and joins by key otherwise.
    cold = homes.join(hot, "key", "left_anti")
    other = lambda frame, name: frame.withColumnsRenamed({"node": name} | {w: f"{name}_{w}" for w in words})
    filed = other(cold if few else cold.select("node", "key"), "b")
    met = other(probes, "a").join(by_key(filed), "key").where("a < b")
    if not few:
        plain = prints.select("node", *words)
        met = met.select("a", "b").distinct().join(by_key(other(plain, "a")), "a").join(by_key(other(plain, "b")), "b")
    apart = sum((F.bit_count(F.col(f"a_{w}").bitwiseXOR(F.col(f"b_{w}"))) for w in words), F.lit(0))
    met = met.where(apart <= distance).select("a", "b")
    if hot.isEmpty():
        return met
    members = stored(probes.join(hot.select("key"), "key", "left_semi").select("node", "key").distinct(), "members")
    sizes = members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    every = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda o: F.struct(F.least(F.col("block"), o).alias("one"), F.greatest(F.col("block"), o).alias("two")),
    )
    pairs = dealt.join(by_key(prints), "node").select("key", "node", *words, F.explode(every).alias("pair"))
    trees = pairs.groupBy("key", "pair").applyInPandas(
        lambda frame: _forest(frame, words, distance), "a bigint, b bigint"
    )
    return met.unionByName(trees)


def cut(word: str, radius: int, rows: int) -> list[tuple[str, int, int, int]]:
    """Segments of a 64-bit word that find all fingerprints within ``radius``: the segments' own radii
    plus one add up to ``radius + 1``."""
    parts = min(radius + 1, 3 if rows < FEW else 2)
    edges = [64 * i // parts for i in range(parts + 1)]
    return [(word, edges[i], edges[i + 1] - edges[i], (radius + 1 + i) // parts - 1) for i in range(parts)]


def classes(rows: DataFrame, distance: int, segments) -> DataFrame:
    """(_id, words..., component_id) from fingerprints; ``segments`` gets the number of different ones."""
    words = [c for c in rows.columns if c != "_id"]
    node = F.col(words[0]) if len(words) == 1 else F.xxhash64(*words)
    distinct = stored(rows.groupBy(*words).agg(F.min("_id").alias("first")).withColumn("node", node), "distinct")
    found = links(distinct.select("node", *words), distance, segments(distinct.count()))
    linked = stored(components(found).join(by_key(distinct.select("node", "first")), "node"), "linked")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    of = linked.join(by_key(least), "root").select("node", "least")
    first = distinct.join(by_key(of), "node", "left").select(*words, F.coalesce("least", "first").alias("component_id"))
    return rows.join(by_key(first), words)


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = 4, radius: int = 4) -> DataFrame:
    """(id, fingerprint, component_id) of every row; ``component_id`` is the smallest id reachable.

    Null and empty texts have the fingerprint zero and link like any other. A text of fewer than
    ``k`` words is one shingle. Repeated rows are repeated in the result. Ties cannot occur: ids
    are compared, never row order. Other columns are ignored. The work on buckets grows with the
    number of different fingerprints, not with copies; the blocks of a hot bucket are compared
    pairwise, so their time, though not their rows, grows with the square of its size.
    """
    shared_dir(docs.sparkSession)
    rows = stored(fingerprints(docs, id, text, k), "prints")
    found = classes(rows, radius, lambda n: cut("w0", radius, n))
    return found.select(F.col("_id").alias(id), F.lower(F.lpad(F.hex("w0"), 16, "0")).alias("fingerprint"), "component_id")


#: Words of bits, and bits that may differ, where texts of a Jaccard similarity of 0.8 are meant: their
#: shingle vectors have a cosine of 2 * 0.8 / (1 + 0.8), so arccos(0.889) / pi = 15.1 % of 384 bits, or 58,
#: differ in the mean, give or take 7.
WORDS, DISTANCE = 6, 60


def similar(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = 5) -> DataFrame:
    """(id, component_id): classes of texts about 0.8 similar or more over ``k``-word shingles.

    One word of 64 bits is too narrow for that, so there are WORDS of them. Each is cut in three, and
    every segment looks up its ball of radius one. Pairs up to 35 bits apart always meet in one of
    the eighteen segments, pairs 48 bits apart (0.86 similar) in 99 of 100 cases, at the limit in 94.
    Nulls, empty texts and repeated rows are treated as by :func:`near_duplicates`.
    """
    shared_dir(docs.sparkSession)
    rows = stored(fingerprints(docs, id, text, k, WORDS), "prints")
    thirds = ((0, 21), (21, 21), (42, 22))
    found = classes(rows, DISTANCE, lambda n: [(f"w{w}", at, width, 1) for w in range(WORDS) for at, width in thirds])
    return found.select(F.col("_id").alias(id), "component_id")
