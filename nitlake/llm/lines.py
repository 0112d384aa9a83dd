"""Lines that many documents hold, taken out of all of them but the last.

A line's key is the line without the white space around it, in lower case. Spark counts the documents
of every key. The keys that occur often enough are dealt into shards by hash; each shard is a minimal
perfect hash over its line hashes and three arrays in its order: a fingerprint, the number of documents
and the largest document. Documents probe the arrays; no line is joined and no text is shuffled.

Keys are 128 bits: both halves choose the slot, and the second is the fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .perfect import Perfect
from .words import SPACE, Block, Rolling, blocks, column

LEAST_CHARS = 40
LEAST_DOCS = 5
#: Keys of a shard: what one task builds at once, seven megabytes.
SHARD = 1 << 18
#: Bytes of arrays that are sent to tasks at once; with more, documents are gone through again for the rest.
HELD = 64_000_000

_NO_ID = np.iinfo(np.int64).min
_COUNTED = "one bigint, two bigint, docs bigint, latest bigint"
_ARRAYS = "shard int, levels binary, words binary, prints binary, docs binary, latest binary"


class Lines:
    """The lines of a block's texts, and the keys of those with enough code points."""

    def __init__(self, block: Block, least: int):
        data = block.data
        breaks = np.flatnonzero(data == 0x0A)
        of = block.owner(breaks)
        self.count = 1 + np.bincount(of, minlength=block.texts)
        self.first = np.cumsum(self.count) - self.count
        total = int(self.count.sum())
        opening, closing = np.zeros(total, bool), np.zeros(total, bool)
        opening[self.first] = True
        closing[self.first + self.count - 1] = True
        self.start, self.end = np.empty(total, np.int64), np.empty(total, np.int64)
        self.start[opening], self.start[~opening] = block.start, breaks + 1
        self.end[closing], self.end[~closing] = block.end, breaks
        dark = np.flatnonzero(~SPACE[data])
        lead = np.searchsorted(dark, self.start)
        trail = np.searchsorted(dark, self.end)
        some = np.flatnonzero(trail > lead)
        begin, stop = dark[lead[some]], dark[trail[some] - 1] + 1
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        enough = points[stop] - points[begin] >= least
        self.long = some[enough]
        self.text = np.repeat(np.arange(block.texts), self.count)[self.long]
        if len(self.long):
            lower = data + np.uint8(32) * ((data >= 65) & (data <= 90))
            spans = begin[enough], stop[enough]
            self.one, self.two = (Rolling(lower, seed).spans(*spans) for seed in (11, 12))
        else:
            self.one = self.two = np.zeros(0, np.uint64)


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("_id").fill_null(_NO_ID).to_numpy(zero_copy_only=False)


def _counted(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _ids(batch)
            for block in blocks(*column(batch, "_text")):
                found = Lines(block, least)
                if not len(found.long):
                    continue
                order = np.lexsort((found.text, found.two, found.one))
                one, two, text = found.one[order], found.two[order], found.text[order]
                new = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
                other = new | np.concatenate([[True], text[1:] != text[:-1]])
                begin = np.flatnonzero(new)
                docs = np.add.reduceat(other.astype(np.int64), begin)
                latest = np.maximum.reduceat(ids[block.rows][text], begin)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one[begin].view(np.int64)), pa.array(two[begin].view(np.int64)), pa.array(docs), pa.array(latest)],
                    names=["one", "two", "docs", "latest"],
                )

    return run


def _built(group: pa.Table) -> pa.Table:
    one, two = (group.column(c).to_numpy().view(np.uint64) for c in ("one", "two"))
    docs, latest = (group.column(c).to_numpy() for c in ("docs", "latest"))
    perfect = Perfect.build(one, two)
    at = np.argsort(perfect.slots(one, two))
    # Counts beyond 32 bits are as good as the largest that fits.
    few = np.minimum(docs[at], np.iinfo(np.uint32).max).astype("<u4")
    arrays = perfect.sizes, perfect.words, two[at], few, latest[at]
    held = [pa.array([a.tobytes()], pa.binary()) for a in arrays]
    return pa.table([pa.array([group.column("shard")[0].as_py()], pa.int32()), *held], names=[c.split()[0] for c in _ARRAYS.split(", ")])


class Shard:
    """One shard's arrays, as tasks probe them."""

    def __init__(self, row: dict):
        self.perfect = Perfect(np.frombuffer(row["levels"], np.int64), np.frombuffer(row["words"], np.uint64))
        self.prints = np.frombuffer(row["prints"], np.uint64)
        self.docs, self.latest = np.frombuffer(row["docs"], "<u4"), np.frombuffer(row["latest"], np.int64)

    def probe(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, largest document) of each key; no documents for keys that are not here."""
        slot = self.perfect.slots(one, two)
        known = slot >= 0
        known[known] = self.prints[slot[known]] == two[known]
        docs, latest = np.zeros(len(one), np.int64), np.full(len(one), _NO_ID)
        docs[known], latest[known] = self.docs[slot[known]], self.latest[slot[known]]
        return docs, latest


def line_index(docs: DataFrame, id: str, text: str, least_chars: int, least_docs: int, shard: int = SHARD) -> tuple[DataFrame, int]:
    """The shards of all keys that ``least_docs`` documents hold, as a stored table, and their number."""
    rows = docs.select(F.col(id).cast("bigint").alias("_id"), F.col(text).alias("_text"))
    counted = rows.mapInArrow(_counted(least_chars), _COUNTED).groupBy("one", "two")
    often = counted.agg(F.sum("docs").alias("docs"), F.max("latest").alias("latest")).where(F.col("docs") >= least_docs)
    often = stored(often, "lines")
    shards = max(1, -(-often.count() // shard))
    dealt = often.withColumn("shard", F.pmod(F.col("one"), F.lit(shards)).cast("int"))
    return stored(dealt.groupBy("shard").applyInArrow(_built, _ARRAYS), "line-shards"), shards


def _applied(index: Broadcast, shards: int, least_chars: int, least_docs: int, first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = {row["shard"]: Shard(row) for row in index.value}
        for batch in batches:
            ids = _ids(batch)
            for block in blocks(*column(batch, "_text")):
                found = Lines(block, least_chars)
                part = batch.slice(block.rows.start, block.texts)
                drop = np.zeros(int(found.count.sum()), bool)
                home = np.mod(found.one.view(np.int64), shards)
                for number, shard in opened.items():
                    mine = np.flatnonzero(home == number)
                    held, latest = shard.probe(found.one[mine], found.two[mine])
                    drop[found.long[mine]] = (held >= least_docs) & (ids[block.rows][found.text[mine]] < latest)
                dropped = np.add.reduceat(drop, found.first, dtype=np.int64)
                lines = pa.array(found.count) if first else part.column("n_lines")
                before = 0 if first else part.column("n_dropped").to_numpy()
                kept = pa.array(_kept(block, found, drop, dropped), pa.binary()).view(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), kept, lines, pa.array(dropped + before)], names=["_id", "_text", "n_lines", "n_dropped"]
                )

    return run


def _kept(block: Block, found: Lines, drop: np.ndarray, dropped: np.ndarray) -> list[bytes]:
    """Each text without its dropped lines."""
    held = block.data.tobytes()
    out = []
    starts, ends = block.start.tolist(), block.end.tolist()
    for text, number in enumerate(dropped.tolist()):
        if not number:
            out.append(held[starts[text] : ends[text]])
            continue
        mine = slice(found.first[text], found.first[text] + found.count[text])
        stay = ~drop[mine]
        lines = zip(found.start[mine][stay].tolist(), found.end[mine][stay].tolist(), strict=True)
        out.append(b"\n".join(held[a:b] for a, b in lines))
    return out


def without_common_lines(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    least_chars: int = LEAST_CHARS,
    least_docs: int = LEAST_DOCS,
    shard: int = SHARD,
    held: int = HELD,
) -> DataFrame:
    """(id, text, n_lines, n_dropped) of every row; ``text`` is what stays, ``n_lines`` what there was.

    Lines whose key has ``least_chars`` code points or more and is in ``least_docs`` rows or more go,
    except from the rows with the largest id that holds the key; a row that holds a key several times
    counts once. Each row is a document: rows that repeat an id count by themselves, and if their id is
    the largest, all of them keep the line. Ids are cast to bigint; a null id is the smallest. A null
    text is one empty line. Other columns are ignored. An empty table gives none.

    Arrays of at most ``held`` bytes (or of one shard) are sent to tasks at once. An index of more takes
    as many passes as it has such parts, each over the texts that the one before has written.
    """
    index, shards = line_index(docs, id, text, least_chars, least_docs, shard)
    size = sum((F.octet_length(c) for c in ("levels", "words", "prints", "docs", "latest")), F.lit(0))
    parts: list[list[int]] = [[]]
    room = held
    for row in index.select("shard", size.alias("bytes")).orderBy("shard").toLocalIterator():
        if parts[-1] and row["bytes"] > room:
            parts.append([])
            room = held
        parts[-1].append(row["shard"])
        room -= row["bytes"]
    rows = docs.select(F.col(id).cast("bigint").alias("_id"), F.col(text).alias("_text"))
    for number, part in enumerate(parts):
        if number:
            rows = stored(rows, "lines-left")
        chosen = index.where(F.col("shard").between(part[0], part[-1])).toArrow().to_pylist() if part else []
        sent = docs.sparkSession.sparkContext.broadcast(chosen)
        run = _applied(sent, shards, least_chars, least_docs, not number)
        rows = rows.mapInArrow(run, "_id bigint, _text string, n_lines bigint, n_dropped bigint")
    return rows.select(F.col("_id").alias(id), F.col("_text").alias(text), "n_lines", "n_dropped")


def digests(docs: DataFrame) -> DataFrame:
    """The contract's rows: a digest of what stays of every document."""
    return without_common_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
often AS (
  SELECT key, max(doc_id) AS latest FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
told AS (
  SELECT k.*, coalesce(k.doc_id < o.latest, false) AS gone FROM keyed k LEFT JOIN often o ON k.key = o.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM told GROUP BY doc_id
"""
