"""Removal of repeated passages with a logarithmic family of sparse suffix arrays.

The rule: a byte goes if it lies in a string of LENGTH bytes that also starts earlier, in a
smaller document id or at an earlier place of the same document.

Suffixes are sampled by content: every window of LENGTH bytes has one anchor, the smallest hash
among its KEY-byte strings. Equal windows have their anchors at the same place, so only suffixes
at anchors (one in about thirty) need to be indexed. Their sorted keys are the suffix arrays:

* Documents come in batches by id. A batch's array is written sorted in buckets of its key, and
  becomes a level. Two levels of the same rank are merged into one of the next, so that a suffix
  is written once per rank; levels of other ranks are scanned. Both are merge joins, bucket by
  bucket and without a shuffle. Keys that meet start possible long matches.
* Suffixes whose key occurs twice are resolved exactly. An anchor's span is all of its windows'
  bytes. A span that occurred before goes as a whole. Of a key with spans of several kinds, the
  first of each kind may share windows with others. It can only with those that it shares the bytes
  on one side of the key with; where it does, it is fetched with its text, and windows are compared.
* A key with very many kinds of spans does not go to one task: its spans and windows are spread,
  and grouped span by span and window by window.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import number_rows
from ..session import discard, shared_dir, stored
from .filters import key_filter, passes
from .words import BLOCK, Block, Rolling, blocks, column, mixed, ranges

LENGTH = 100
KEY = 32
BATCHES = 4
#: The spans of a key with more kinds than this are spread over tasks, which costs a row per window;
#: up to this many are compared in one task, some offsets from the anchor at a time.
HOT = 50_000
OFFSETS = 18
#: Windows that begin at most this far before their anchor hold the HALF bytes behind its key; others
#: hold as many before it and one more.
HALF = (LENGTH - KEY) // 2
_PLACE = np.uint64((1 << 22) - 1)


def pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[Block, int]]:
    """Blocks of texts; a text longer than a block comes in pieces that share LENGTH - 1 bytes.
    With each, how many bytes of its (then only) text come before it."""
    for block in blocks(data, offsets):
        if block.texts > 1 or len(block.data) <= 2 * BLOCK:
            yield block, 0
        else:
            for at in range(0, len(block.data) - LENGTH + 1, BLOCK):
                part = block.data[at : at + BLOCK + LENGTH - 1]
                yield Block(part, np.array([0, len(part)]), block.rows), at


class Runs:
    """The anchors of a block: for each, its key, its text, and the first and last window it anchors."""

    def __init__(self, block: Block):
        self.rolling = Rolling(block.data)
        sizes = np.maximum(block.end - block.start - (LENGTH - 1), 0)
        at = ranges(block.start, sizes)
        if not len(at):
            self.key, self.text = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            self.first = self.last = self.anchor = self.text
            return
        hashes = self.rolling.every(KEY)
        packed = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
        wide, reach = packed, 1
        width = LENGTH - KEY + 1
        while 2 * reach <= width:
            wide = np.minimum(wide[:-reach], wide[reach:])
            reach *= 2
        if reach < width:
            wide = np.minimum(wide[: len(wide) - (width - reach)], wide[width - reach :])
        anchor = (wide[at] & _PLACE).astype(np.int64)
        begin = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        self.anchor = anchor[begin]
        self.key = hashes[self.anchor]
        self.first = at[begin]
        self.last = at[np.concatenate([begin[1:], [len(at)]]) - 1]
        self.text = block.owner(self.first)

    def spans(self) -> np.ndarray:
        return self.rolling.spans(self.first, self.last + LENGTH)

    def sides(self, pick: np.ndarray) -> list[np.ndarray]:
        """Hashes of the key with what is before it, and with what is behind it; where no window of
        the span holds that, a hash that nothing else has."""
        at, out = self.anchor[pick], []
        for holds, start, end in (
            (self.first[pick] < at - HALF, at - HALF - 1, at + KEY),
            (self.last[pick] >= at - HALF, at, at + KEY + HALF),
        ):
            found = mixed(self.rolling.inverse[at] + pick.astype(np.uint64))
            found[holds] = self.rolling.spans(start[holds], end[holds])
            out.append(found)
        return out


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch of documents: the keys of its anchors, with occurrences and different surroundings."""
    for batch in batches:
        group = batch.column("_batch").to_numpy()
        data, offsets = column(batch, "_text")
        for block, _ in pieces(data, offsets):
            runs = Runs(block)
            of = group[block.rows][runs.text] if block.texts > 1 else np.full(len(runs.key), group[block.rows][0])
            for part in np.unique(of):
                mine = of == part
                key, span = runs.key[mine], runs.spans()[mine]
                order = np.lexsort((span, key))
                key, span = key[order], span[order]
                new = np.concatenate([[True], key[1:] != key[:-1]])
                other = new | np.concatenate([[True], span[1:] != span[:-1]])
                begin = np.flatnonzero(new)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(begin), part, np.int32)), pa.array(key[begin].view(np.int64)),
                        pa.array(np.diff(np.append(begin, len(key)))),
                        pa.array(np.add.reduceat(other.astype(np.int64), begin)),
                    ],
                    names=["batch", "key", "n", "spans"],
                )


class Family:
    """Sorted suffix arrays of ranks 0, 1, 2, ...: at most one per rank once a batch is in."""

    def __init__(self, spark, buckets: int):
        self.spark, self.buckets = spark, buckets
        self.levels: list[tuple[int, DataFrame]] = []
        self.tables: list[DataFrame] = []

    def sorted(self, rows: DataFrame) -> DataFrame:
        """``rows`` in bucketed, sorted files in the shared folder: a join by key then only merges."""
        name = f"nitlake_suffixes_{uuid.uuid4().hex}"
        place = f"{shared_dir(self.spark)}/{name}"
        writer = rows.write.option("path", place).bucketBy(self.buckets, "key").sortBy("key")
        if "batch" in rows.columns:
            writer = writer.partitionBy("batch")
        writer.saveAsTable(name)
        table = self.spark.table(name)
        table._nitlake_name, table._nitlake_place = name, place
        self.tables.append(table)
        return table

    def add(self, array: DataFrame) -> list[DataFrame]:
        """Let a batch's array (key, n, spans) in. Merging adds up the occurrences of keys; levels
        that are not merged now are scanned, and the keys of the batch that they hold are returned."""
        self.levels.append((0, array))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (rank, one), (_, other) = self.levels.pop(), self.levels.pop()
            both = one.withColumnsRenamed({"n": "n1", "spans": "s1"}).join(other, "key", "full_outer")
            total = lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
            merged = both.select("key", total("n1", "n").alias("n"), total("s1", "spans").alias("spans"))
            self.levels.append((rank + 1, self.sorted(merged)))
        met = [array.join(level.select("key"), "key", "left_semi").select("key") for _, level in self.levels[:-1]]
        return [stored(keys, "met") for keys in met]

    def repeated(self, met: list[DataFrame]) -> DataFrame:
        """Keys that occur twice or more: within a level, or where a scan met."""
        return _union([level.where("n > 1").select("key") for _, level in self.levels] + met)

    def frequent(self, more: int) -> DataFrame:
        """Keys with more than ``more`` kinds of spans over all levels."""
        share = more // len(self.levels)  # in one level at least
        parts = _union([level.where(F.col("spans") > share).select("key") for _, level in self.levels]).distinct()
        found = _union([level.join(parts, "key", "left_semi").select("key", "spans") for _, level in self.levels])
        return found.groupBy("key").agg(F.sum("spans").alias("spans")).where(F.col("spans") > more).select("key")

    def close(self) -> None:
        for table in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table._nitlake_name}")
        discard(*self.tables)


ROW = "deal bigint, id bigint, start bigint, end bigint, key bigint, span bigint, left bigint, right bigint, apart boolean"
_NAMES = ["deal", "id", "start", "end", "key", "span", "left", "right", "apart"]


def _candidates(repeated, hot):
    """Spans whose key may be repeated; what repeats within a block is settled here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, before, ids in _blocks(batches):
            runs = Runs(block)
            pick = np.flatnonzero(passes(repeated.value, runs.key))
            if not len(pick):
                continue
            span, text = runs.spans()[pick], runs.text[pick]
            own, key = ids[text], runs.key[pick]
            at = runs.first[pick] - block.start[text] + before
            end = at + runs.last[pick] - runs.first[pick] + LENGTH
            order = np.lexsort((at, own))
            own, at, end, key, span, pick = (x[order] for x in (own, at, end, key, span, pick))
            new, later = _first(own, at, span ^ key)
            yield _intervals(own[later], at[later], end[later])
            own, at, end, key, span = (x[new] for x in (own, at, end, key, span))
            apart = passes(hot.value, key)
            deal = np.where(apart, _place(own, at), key)
            yield _rows(apart, deal, own, at, end, key, span, *runs.sides(pick[new]))

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, int, np.ndarray]]:
    for batch in batches:
        ids = batch.column("_id").to_numpy()
        for block, before in pieces(*column(batch, "_text")):
            yield block, before, ids[block.rows]


def _place(own: np.ndarray, at: np.ndarray) -> np.ndarray:
    return mixed(mixed(own.view(np.uint64)) + at.view(np.uint64))


def _first(own: np.ndarray, at: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in order of (own, at): the first of each ``what``, and those that come after it. A row
    that is repeated has its first occurrence in the same place, and is neither."""
    _, head, of = np.unique(what, return_index=True, return_inverse=True)
    first = head[of]
    return first == np.arange(len(what)), (own != own[first]) | (at != at[first])


def _rows(apart: np.ndarray, *values: np.ndarray) -> pa.RecordBatch:
    fixed = [pa.array(x.view(np.int64)) for x in values]
    fixed += [pa.nulls(len(apart), pa.int64())] * (len(_NAMES) - 1 - len(fixed))
    return pa.RecordBatch.from_arrays([*fixed, pa.array(apart, pa.bool_())], names=_NAMES)


def _intervals(own: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Settled removals, from spans sorted by (id, start); those that touch are merged."""
    if len(own):
        new = np.concatenate([[True], (own[1:] != own[:-1]) | (start[1:] > end[:-1])])
        head = np.flatnonzero(new)
        own, start, end = own[head], start[head], np.maximum.reduceat(end, head)
    return _rows(np.zeros(len(own), bool), _place(own, start), own, start, end, np.zeros(len(own), np.int64))


def _by_key(batches: Iterator[pa.RecordBatch], settle, own=None) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, worked on by ``settle`` some thousands at a time, the rows of a key together."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if own is not None:
            mine = own(batch)
            through = batch.filter(pc.invert(mine))
            if through.num_rows:
                yield through
            batch = batch.filter(mine)
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= 20_000:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            keys = whole.column("key").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
            if cut:
                yield from settle(whole.slice(0, cut))
                whole = whole.slice(cut)
            held, size = [whole], whole.num_rows
    if size:
        yield from settle(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans sorted by key. Out come removals, and the first of each kind that shares a side with
    another kind; settled and spread rows go through."""
    return _by_key(batches, _settle_spans, lambda b: pc.and_(pc.is_valid(b.column("span")), pc.invert(b.column("apart"))))


def _settle_spans(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    names = ("id", "start", "end", "key", "span", "left", "right")
    held = [batch.column(c).to_numpy() for c in names]
    order = np.lexsort((held[1], held[0]))
    own, start, end, key, span, left, right = held = [x[order] for x in held]
    new, later = _first(own, start, span ^ key)
    yield _intervals(own[later], start[later], end[later])
    shared = np.zeros(int(new.sum()), bool)
    for side in (left, right):
        _, of, kinds = np.unique(side[new], return_inverse=True, return_counts=True)
        shared |= kinds[of] > 1
    held = [x[new][shared] for x in held]
    yield _rows(np.zeros(len(held[0]), bool), _place(held[0], held[1]), *held)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own, start = (batch.column(c).to_numpy() for c in ("id", "start"))
        yield pa.RecordBatch.from_arrays([pa.array(_place(own, start).view(np.int64))], names=["place"])


_TEXT = "id bigint, start bigint, key bigint, anchor bigint, apart boolean, text binary"


def _fetched(repeated, wanted, hot):
    """The text of wanted spans (and of a few others that the filters let through)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, before, ids in _blocks(batches):
            runs = Runs(block)
            own, at = ids[runs.text], runs.first - block.start[runs.text] + before
            place = _place(own, at)
            pick = np.flatnonzero(passes(repeated.value, runs.key) & passes(wanted.value, place))
            if not len(pick):
                continue
            sizes = runs.last[pick] - runs.first[pick] + LENGTH
            text = pa.Array.from_buffers(
                pa.binary(), len(pick),
                [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)),
                 pa.py_buffer(block.data[ranges(runs.first[pick], sizes)].tobytes())],
            )
            fixed = [pa.array(x[pick].view(np.int64)) for x in (own, at, runs.key, runs.anchor - runs.first)]
            yield pa.RecordBatch.from_arrays(
                [*fixed, pa.array(passes(hot.value, runs.key[pick])), text],
                names=["id", "start", "key", "anchor", "apart", "text"],
            )

    return run


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of spans sorted by key: windows that occurred before under the same key."""
    for made in _by_key(batches, _settle_windows):
        yield made.select(["id", "start", "end"])


def _settle_windows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Equal windows lie at the same offset from their anchor, so offsets are worked on in turn."""
    data, offsets = column(batch, "text")
    hashes = Rolling(data).every(LENGTH)
    for low in range(0, LENGTH - KEY + 1, OFFSETS):
        at, key, own, place = _window_rows(batch, offsets, low, low + OFFSETS)
        if not len(at):
            continue
        order = np.lexsort((place, own))
        at, key, own, place = (x[order] for x in (at, key, own, place))
        _, later = _first(own, place, mixed(hashes[at] + key.view(np.uint64)))
        yield _intervals(own[later], place[later], place[later] + LENGTH)


def _window_rows(batch: pa.RecordBatch, offsets: np.ndarray, low: int, high: int) -> tuple[np.ndarray, ...]:
    """(place in the batch, key, id, place in the text) of windows that begin ``low`` to ``high`` bytes
    (the latter not included) before their anchor."""
    anchor = batch.column("anchor").to_numpy()
    first = np.maximum(anchor - high + 1, 0)
    last = np.minimum(anchor - low, np.diff(offsets) - LENGTH)
    windows = np.maximum(last - first + 1, 0)
    own, start, key = (np.repeat(batch.column(c).to_numpy(), windows) for c in ("id", "start", "key"))
    within = ranges(first, windows)
    return np.repeat(offsets[:-1], windows) + within, key, own, start + within


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = column(batch, "text")
        at, key, own, place = _window_rows(batch, offsets, 0, LENGTH)
        found = Rolling(data).every(LENGTH)[at].view(np.int64), key, own, place
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["window", "key", "id", "start"])


def _after_first(rows: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Spread rows: the first of each kind, and the rows that come after it. Spark combines minima
    before it shuffles, and can split the join's large keys."""
    least = rows.groupBy(*by).agg(F.min(F.struct("id", "start")).alias("least"))
    return least, rows.join(least, by).where(F.struct("id", "start") != F.col("least"))


def documents(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_id`` and ``_text``, and ``_own``: a number of each document, in the order in
    which documents come.

    That is the id where each id has one text. Where an id has several, or is null, documents are
    numbered by (id, SHA-256 of the text), null ids first: each text of an id is a document of its own,
    and rows that repeat id and text are one. A null text is an empty one.
    """
    held = F.coalesce(F.col("_text"), F.lit(""))
    texts = rows.groupBy("_id").agg(F.min(F.xxhash64(held)).alias("low"), F.max(F.xxhash64(held)).alias("high"))
    if texts.where("_id IS NULL OR low != high").isEmpty():
        return rows.withColumn("_own", F.col("_id"))
    marked = rows.withColumns({"_digest": F.sha2(held, 256), "_none": F.col("_id").isNull(), "_at": F.coalesce("_id", F.lit(0))})
    order = ["_none", "_at", "_digest"]
    found = marked.select((~F.col("_none")).alias("_some"), *order).distinct()
    numbers = number_rows(found, ["_some", "_at", "_digest"], out="_own").drop("_some")
    return stored(marked.join(numbers, order).drop(*order), "documents")


def removals(rows: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(id, start, end) for rows of :func:`documents`: byte spans to remove from the texts numbered ``id``,
    in any order, touching or overlapping ones not yet merged."""
    spark = rows.sparkSession
    rows = rows.select(F.col("_own").alias("_id"), "_text").where(F.octet_length("_text") >= LENGTH)
    total = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (1 << 26))
    cuts = rows.approxQuantile("_id", [i / batches for i in range(1, batches)], 0.02)
    batch = sum([F.coalesce((F.col("_id") > c).cast("int"), F.lit(0)) for c in sorted(set(cuts))], F.lit(0))
    keys = rows.select(batch.alias("_batch"), "_text").mapInArrow(_keys, "batch int, key bigint, n bigint, spans bigint")
    family = Family(spark, buckets)
    summed = keys.repartition(buckets, "key").groupBy("batch", "key").agg(F.sum("n").alias("n"), F.sum("spans").alias("spans"))
    arrays = family.sorted(summed)
    met: list[DataFrame] = []
    for i in range(len(set(cuts)) + 1):
        met += family.add(arrays.where(F.col("batch") == i).select("key", "n", "spans"))
    repeated, often = stored(family.repeated(met), "repeated"), stored(family.frequent(HOT), "often")
    known, hot = key_filter(repeated, "key", repeated.count()), key_filter(often, "key", often.count())
    family.close()
    discard(*met, repeated, often)

    dealt = rows.mapInArrow(_candidates(known, hot), ROW).repartition(buckets, "deal").sortWithinPartitions("key")
    settled = stored(dealt.mapInArrow(_resolved, ROW), "settled")
    done = [settled.where(F.col("span").isNull()).select("id", "start", "end")]
    spread = settled.where(F.col("apart") & F.col("span").isNotNull())
    _, again = _after_first(spread, ["key", "span"])
    done.append(again.select("id", "start", "end"))
    kinds = spread.groupBy("key", "span").agg(
        F.min(F.struct("id", "start")).alias("least"), F.min("left").alias("left"), F.min("right").alias("right")
    )
    sides = kinds.select("least", F.explode(F.array("left", "right")).alias("side"))
    common = sides.groupBy("side").agg(F.count("*").alias("n")).where("n > 1").select("side")
    shared = sides.join(common, "side", "left_semi").select("least.id", "least.start").distinct()
    wanted = settled.where(~F.col("apart") & F.col("span").isNotNull()).select("id", "start")
    wanted = stored(wanted.unionByName(shared).mapInArrow(_places, "place bigint"), "wanted")
    chosen = key_filter(wanted, "place", wanted.count())
    discard(wanted)

    texts = stored(rows.mapInArrow(_fetched(known, chosen, hot), _TEXT), "spans")
    close = texts.where("not apart").repartition(buckets, "key").sortWithinPartitions("key")
    done.append(close.mapInArrow(_compared, "id bigint, start bigint, end bigint"))
    windows = texts.where("apart").mapInArrow(_windows, "window bigint, key bigint, id bigint, start bigint")
    _, again = _after_first(windows, ["key", "window"])
    done.append(again.select("id", "start", (F.col("start") + LENGTH).alias("end")))
    return _union(done)


def _union(tables: list[DataFrame]) -> DataFrame:
    made = tables[0]
    for table in tables[1:]:
        made = made.unionByName(table)
    return made


def _merged(spans: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _lighten(touched):
    """Texts that lose nothing are digested here and leave their text behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column(batch, "_text")
            held = data.tobytes()
            ids = batch.column("_own").to_numpy()
            # What Spark's xxhash64 makes of a bigint.
            keys = [xxhash.xxh64_intdigest(i.tobytes(), 42) for i in ids]
            keep = passes(touched.value, np.array(keys, np.uint64))
            size, digest, text = [], [], []
            for i in range(len(ids)):
                one = held[offsets[i] : offsets[i + 1]]
                size.append(len(one))
                digest.append(None if keep[i] else hashlib.sha256(one).hexdigest())
                text.append(one if keep[i] else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_own"), pa.array(size, pa.int64()), pa.array(digest, pa.string()), pa.array(text, pa.binary())],
                names=["_id", "_own", "n_bytes", "digest", "_text"],
            )

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, runs, digest = [], [], []
        for row in batch.to_pylist():
            spans = _merged(row["spans"] or [])
            removed.append(sum(b - a for a, b in spans))
            runs.append(len(spans))
            digest.append(row["digest"] or hashlib.sha256(cut_out(row["_text"], spans)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id"), batch.column("n_bytes"), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string())],
            names=["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def cut_out(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for start, end in spans:
        parts.append(text[at:start])
        at = end
    return b"".join([*parts, text[at:]])


def passages_by_text(found: DataFrame) -> DataFrame:
    """(id, spans) of the texts that lose something; a text has no more spans than bytes."""
    return found.groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def removal_digests(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row.

    Ids are integers; a null id comes before all others. Null and empty texts have no bytes and lose
    none; texts under LENGTH bytes lose none. Rows that repeat an id and text are one document: they
    lose the same and none of it to each other. Other texts of an id are documents of their own, that
    with the smaller SHA-256 is the earlier one. Other columns are ignored. Only texts that lose
    something are shuffled, or all where ids repeat with other texts or are null.
    """
    rows = documents(docs.select(F.col(id).cast("bigint").alias("_id"), F.col(text).alias("_text")))
    spans = stored(passages_by_text(removals(rows)), "spans")
    touched = key_filter(spans.select(F.xxhash64("id").alias("key")), "key", spans.count())
    shape = "_id bigint, _own bigint, n_bytes bigint, digest string, _text binary"
    light = rows.select("_id", "_own", "_text").mapInArrow(_lighten(touched), shape)
    joined = light.join(spans, F.col("_own") == F.col("id"), "left").drop("id")
    made = joined.mapInArrow(_digests, "_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    return made.withColumnRenamed("_id", id)


def _whole_characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = []
        for text, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            if text is None or not found:
                kept.append(text)
                continue
            held, spans = text.encode(), []
            for start, end in _merged(found):
                while start < end and held[start] & 0xC0 == 0x80:
                    start += 1
                while end > start and end < len(held) and held[end] & 0xC0 == 0x80:
                    end -= 1
                spans.append((start, end))
            kept.append(cut_out(held, spans).decode())
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(kept, batch.column("text").type)], names=["row", "text"])


def without_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the same columns, repeated passages removed from ``text`` in whole characters:
    a character that is removed in part stays. Nulls, short and repeated rows as in :func:`removal_digests`."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = documents(docs.select(row, F.col(id).cast("bigint").alias("_id"), F.col(text).alias("_text")))
    spans = stored(passages_by_text(removals(rows)), "spans")
    texts = rows.select("row", F.col("_text").alias("text"), "_own")
    joined = texts.join(spans, F.col("_own") == F.col("id"), "left").select("row", "text", "spans")
    made = joined.mapInArrow(_whole_characters, texts.select("row", "text").schema)
    return made.select(*[F.col("text").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
