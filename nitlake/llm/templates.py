"""Benchmark decontamination by templates.

Words become typed templates: numbers, quantities (a number with its unit in one word), units after
a number, and names (capitals inside a sentence) turn into placeholders. Everything else is a
literal without case and outer punctuation, single letters and words all in capitals too. A capital
that opens a sentence may be a name or not, so every text is read twice: with all of these as
literals, and with all of them as names. The readings are matched and judged apart. A third reading
takes every word by its value: it finds items that are in a document word by word, whatever share
of their words are literals, and items too short for templates. Windows
of SIZE template words are joined by hash with those of the benchmark. Along an alignment of a
document with an item the placeholders must be consistent: one value of the item is one value of
the document wherever it comes up. So a question with other numbers or names in it is found, and
two texts of the same mould by chance are not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir, stored
from .filters import key_filter, passes
from .words import Block, Rolling, blocks, column, mixed, ranges

SIZE = 8
#: Items of fewer words than SHORTEST are too short for templates: only their own words are looked for, if
#: there are two at least. One word alone is found by chance everywhere.
SHORTEST, SHORTEST_COPY = 4, 2
#: A document leaks an item if this many windows of it match (thirteen words in a row) ...
WINDOWS = 6
#: ... or this share of its windows, which hold as large a share of its words.
SHARE = 0.5

# Units that count as such after a number.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers "
    "g kg mg gram grams kilogram kilograms ton tons tonne tonnes pound pounds lb lbs ounce ounces oz "
    "ml l cl liter liters litre litres gallon gallons s ms second seconds minute minutes min hour hours h day days "
    "week weeks month months year years percent degrees celsius fahrenheit kelvin dollar dollars cent cents euro "
    "euros usd eur hz khz mhz ghz w kw v kv a ma j kj cal kcal n pa kpa bar mol byte bytes kb mb gb tb bits mph"
).split()

LITERAL, NUMBER, QUANTITY, UNIT, NAME = range(5)
#: Readings of a text: capitals that open a sentence are literals, or names; or every word is its value.
PLAIN, NAMED, VALUES = READINGS = range(3)
_TYPE = mixed(np.arange(101, 106, dtype=np.uint64))
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_STOP = np.isin(np.arange(256), [ord(c) for c in ".!?:;\n"])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _unit_hashes() -> np.ndarray:
    data = np.frombuffer("".join(UNITS).encode(), np.uint8)
    ends = np.cumsum([len(u) for u in UNITS])
    return np.sort(Rolling(data).spans(ends - [len(u) for u in UNITS], ends))


_UNIT_HASHES = _unit_hashes()


class Template:
    """Words of a block's texts, and what does not depend on how they are read."""

    def __init__(self, block: Block):
        data, n = block.data, len(block.data)
        before = np.concatenate([[0], data[:-1]]).astype(np.uint8)
        after = np.concatenate([data[1:], [0]]).astype(np.uint8)
        latin = (before == 0xC3) & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)  # capitals of two bytes
        low = _LOWER[data]
        low[latin] += 32
        quote = (data == 0xE2) & (after == 0x80)  # dashes and curly quotes of three bytes
        letter = _LETTER[data]
        for back in range(3):
            at = np.flatnonzero(quote) + back
            letter[at[at < n]] = False
        sums = lambda mask: np.concatenate([[0], np.cumsum(mask)])
        digits, letters, stops = sums(_DIGIT[data]), sums(letter), sums(_STOP[data])
        starts, ends, text = block.words()
        core = np.flatnonzero(letter | _DIGIT[data])
        a, b = np.searchsorted(core, starts), np.searchsorted(core, ends)
        some = b > a
        starts, text = core[a[some]], text[some]
        ends = core[b[some] - 1] + 1
        rolling = Rolling(low)
        value = rolling.spans(starts, ends)
        new = np.concatenate([[True], text[1:] != text[:-1]]) if len(text) else np.zeros(0, bool)
        gap = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        opening = new | (stops[starts] - stops[np.where(new, starts, gap)] > 0)
        capital = ((data[starts] >= 65) & (data[starts] <= 90)) | latin[np.minimum(starts + 1, max(n - 1, 0))] if n else new
        # One letter, or capitals only, are no name.
        wide = latin[np.minimum(starts + 1, max(n - 1, 0))] if n else new
        second = starts + 1 + wide
        inner = data[np.minimum(second, max(n - 1, 0))] if n else starts
        capital = capital & (second < ends) & ~((inner >= 65) & (inner <= 90))
        has_digit, has_letter = digits[ends] > digits[starts], letters[ends] > letters[starts]
        self.starts, self.ends, self.text, self.value, self.new, self.rolling = starts, ends, text, value, new, rolling
        self.name, self.opening = capital & ~has_digit, opening
        self.kind = np.zeros(len(starts), np.int64)
        self.kind[has_digit & has_letter & _DIGIT[data[starts]]] = QUANTITY
        self.kind[has_digit & ~has_letter] = NUMBER


class Reading:
    """Template words of a block's texts: ``hash``, ``kind``, ``value`` and ``text`` of each."""

    def __init__(self, words: Template, reading: int):
        starts, ends, value, new = words.starts, words.ends, words.value, words.new
        self.reading, kind = reading, words.kind.copy()
        if reading == VALUES:
            kind[:] = LITERAL
            self.kind, self.text, self.value, self.hash = kind, words.text, value, value
            return
        kind[words.name & ((reading == NAMED) | ~words.opening)] = NAME
        counted = np.concatenate([[False], kind[:-1] == NUMBER])[: len(kind)] & ~new
        kind[counted & (kind == LITERAL) & np.isin(value, _UNIT_HASHES)] = UNIT
        # Names of several words are one name, which does not reach into the next sentence.
        more = np.concatenate([[False], kind[:-1] == NAME])[: len(kind)] & (kind == NAME) & ~words.opening
        head = np.flatnonzero(~more)
        last = np.concatenate([head[1:], [len(kind)]]) - 1 if len(head) else head
        self.kind, self.text = kind[head], words.text[head]
        self.value = np.where(last > head, words.rolling.spans(starts[head], ends[last]), value[head])
        self.hash = np.where(self.kind == LITERAL, self.value, _TYPE[self.kind])

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, hash) of the windows inside a text of which half the words are literals."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        made = np.full(n, size + 64 * self.reading, np.uint64)
        for i in range(size):
            made = mixed(made * np.uint64(0x9E3779B97F4A7C15) + self.hash[i : n + i])
        literal = np.concatenate([[0], np.cumsum(self.kind == LITERAL)])
        at = np.flatnonzero((self.text[size - 1 :] == self.text[:n]) & (2 * (literal[size:] - literal[:n]) >= size))
        return at, made[at]


_SHAPE = "bigint, reading int, place bigint, key bigint, slots array<bigint>"


def _windowed(sizes: list[int] | None, wanted: Broadcast | None):
    """Windows of documents that pass the filter; without one, all windows of items, whose own
    length is the size where it is below SIZE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("_id")
            data, offsets = column(batch, "_text")
            for block in blocks(data, offsets):
                template = Template(block)
                for words in (Reading(template, r) for r in READINGS):
                    count = np.bincount(words.text, minlength=block.texts)
                    first = np.cumsum(count) - count
                    shortest = SHORTEST_COPY if words.reading == VALUES else SHORTEST
                    for size in sizes or range(SHORTEST_COPY, SIZE + 1):
                        if size < shortest:
                            continue
                        at, key = words.windows(size)
                        if wanted is None:
                            own = count[words.text[at]]
                            take = (own >= SIZE) if size == SIZE else (own == size)
                        else:
                            take = passes(wanted.value, key)
                        at, key = at[take], key[take]
                        if not len(at):
                            continue
                        slot = np.concatenate([[0], np.cumsum(words.kind != LITERAL)])
                        values = words.value[words.kind != LITERAL]
                        sizes_of = slot[at + size] - slot[at]
                        slots = pa.ListArray.from_arrays(
                            np.concatenate([[0], np.cumsum(sizes_of)]).astype(np.int32),
                            pa.array(values[ranges(slot[at], sizes_of)].view(np.int64)),
                        )
                        owner = ids.take(pa.array(block.rows.start + words.text[at]))
                        place = at - first[words.text[at]]
                        yield pa.RecordBatch.from_arrays(
                            [owner, pa.array(np.full(len(at), words.reading, np.int32)), pa.array(place), pa.array(key.view(np.int64)), slots], names=["_id", "reading", "place", "key", "slots"]
                        )

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id",
          item_text: str = "text") -> DataFrame:
    """(id, item, matched, windows, share, slots, changed, kind), a row per document and item it leaks.

    ``matched`` of the item's ``windows`` are in the document on consistent alignments; of the
    ``slots`` met, ``changed`` hold another value; ``kind`` is ``copy`` or ``reparameterised``.
    Null and empty texts have no windows. A window that an item holds twice counts at its first
    place. Of two readings that leak, the one with the greater share is reported. Repeated rows and ids are one document. Other columns are ignored. The filter that
    tasks hold has a fixed greatest size, whatever the benchmark's; what it lets through by
    chance falls out of the join.
    """
    shared_dir(docs.sparkSession)
    rows = lambda frame, i, t: frame.select(F.col(i).cast("bigint").alias("_id"), F.col(t).alias("_text"))
    items = rows(benchmark, item, item_text).mapInArrow(_windowed(None, None), "_id " + _SHAPE)
    first = items.groupBy(F.col("_id").alias("item"), "reading", "key").agg(F.min(F.struct("place", "slots")).alias("at"))
    known = stored(first.select("item", "reading", "key", F.col("at.place").alias("there"), F.col("at.slots").alias("ours")), "items")
    # A window's key holds its size, so only sizes that short items have are looked for besides SIZE.
    lengths = rows(benchmark, item, item_text).mapInArrow(_lengths, "item bigint, reading int, words bigint")
    short = lengths.select("words").distinct().where(F.col("words").between(SHORTEST_COPY, SIZE - 1))
    sizes = [SIZE, *sorted(r["words"] for r in short.collect())]
    wanted = key_filter(known, "key", known.count())
    found = rows(docs, id, text).mapInArrow(_windowed(sizes, wanted), "_id " + _SHAPE)
    met = found.join(known, ["reading", "key"]).select("_id", "item", "reading", "there", (F.col("place") - F.col("there")).alias("line"), "slots", "ours")
    met = stored(met.distinct(), "met")
    line = ["_id", "item", "reading", "line"]
    pair = met.select(*line, F.explode(F.arrays_zip("ours", "slots")).alias("s")).select(*line, "s.ours", "s.slots").distinct()
    filled = pair.groupBy(*line, "ours").agg(F.count("*").alias("values"), F.max((F.col("ours") != F.col("slots")).cast("int")).alias("other"))
    slots = filled.groupBy(*line).agg(
        F.count("*").alias("slots"), F.sum("other").alias("changed"), F.max("values").alias("values")
    )
    # Words of the item that the windows met on a line hold, each counted once.
    held = F.aggregate(
        F.array_sort(F.collect_set("there")), F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("upto")),
        lambda a, at: F.struct((a["n"] + at + SIZE - F.greatest(a["upto"], at)).alias("n"), (at + SIZE).alias("upto")), lambda a: a["n"],
    )
    lines = met.groupBy(*line).agg(F.count("*").alias("matched"), held.alias("held")).join(slots, line, "left")
    even = lines.where(F.coalesce("values", F.lit(1)) == 1)
    total = known.groupBy("item", "reading").agg(F.count("*").alias("windows"))
    sums = even.groupBy("_id", "item", "reading").agg(
        F.sum("matched").alias("matched"), F.coalesce(F.sum("slots"), F.lit(0)).alias("slots"),
        F.coalesce(F.sum("changed"), F.lit(0)).alias("changed"), F.sum("held").alias("held"), F.max("matched").alias("longest"),
    )
    words = lengths.groupBy("item", "reading").agg(F.max("words").alias("words"))
    judged = sums.join(total, ["item", "reading"]).join(words, ["item", "reading"]).withColumn("matched", F.least("matched", "windows"))
    judged = judged.withColumn("share", F.col("matched") / F.col("windows"))
    part = (F.col("matched") >= WINDOWS) | ((F.col("share") >= SHARE) & (F.col("held") >= SHARE * F.col("words")))
    leaked = judged.where(F.when(F.col("reading") == VALUES, F.col("longest") == F.col("windows")).otherwise(part))
    facts = ("matched", "windows", "share", "slots", "changed")
    best = leaked.groupBy("_id", "item").agg(F.max_by(F.struct(*facts), F.struct("share", "matched", -F.col("reading"))).alias("best"))
    return best.select("_id", "item", "best.*").select(
        F.col("_id").alias(id), F.col("item").alias(item), *facts,
        F.when(F.col("changed") > 0, "reparameterised").otherwise("copy").alias("kind"),
    )


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = column(batch, "_text")
        for block in blocks(data, offsets):
            template = Template(block)
            for reading in READINGS:
                count = np.bincount(Reading(template, reading).text, minlength=block.texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").slice(block.rows.start, block.texts), pa.array(np.full(len(count), reading, np.int32)), pa.array(count)],
                    names=["item", "reading", "words"],
                )
