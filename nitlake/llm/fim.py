"""Fill-in-middle: texts cut at units into prefix, middle and suffix, and put together in another order.

Cuts are drawn in units (lines, words or characters), texts are cut in bytes, and lengths are told in
code points. What converts one into the other is a sparse exception index per block of texts: only the
multibyte characters are recorded, each with its place and the bytes it has beyond one. A binary search
in it says how many excess bytes lie before a cut; all ASCII between them is plain arithmetic.

Every text is one row of one task and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import SPACE, Block, blocks, column

#: What stands before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
UNITS = ("line", "word", "character")

_NEWLINE = 0x0A


class Exceptions:
    """The multibyte characters of a block of UTF-8, by place in bytes and in code points."""

    def __init__(self, data: np.ndarray):
        self.at = np.flatnonzero(data >= 0xC0)
        lead = data[self.at]
        excess = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.excess = np.concatenate([[0], np.cumsum(excess)])
        self.points = self.at - self.excess[:-1]

    def to_points(self, cuts: np.ndarray) -> np.ndarray:
        """Code points before byte places that begin characters."""
        return cuts - self.excess[np.searchsorted(self.at, cuts)]

    def to_bytes(self, points: np.ndarray) -> np.ndarray:
        """Bytes before code points."""
        return points + self.excess[np.searchsorted(self.points, points)]


class Units:
    """Where the units of each text of a block begin; a text's units lie end to end."""

    def __init__(self, block: Block, unit: str, index: Exceptions):
        self.block, self.unit, self.index = block, unit, index
        data = block.data
        if unit == "character":
            self.base = index.to_points(block.start)
            self.count = index.to_points(block.end) - self.base
            return
        if unit == "line":
            ends = np.flatnonzero(data == _NEWLINE) + 1
        else:  # a word with the white space behind it; white space that opens a text is a unit
            inside = ~SPACE[data]
            ends = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        # A text's end closes its last unit, whatever it ends with.
        self.ends = np.union1d(ends, block.end[block.end > block.start])
        self.base = np.searchsorted(self.ends, block.start, side="right")
        self.count = np.searchsorted(self.ends, block.end, side="right") - self.base

    def places(self, units: np.ndarray) -> np.ndarray:
        """The byte at which each text's first ``units`` units are over."""
        if self.unit == "character":
            return self.index.to_bytes(self.base + units)
        if not len(self.ends):
            return self.block.start.copy()
        found = self.ends[np.clip(self.base + units - 1, 0, len(self.ends) - 1)]
        return np.where(units > 0, found, self.block.start)


def _arranged(unit: str, sentinels: Sequence[str], rate: int, spm: int):
    marks = [s.encode() for s in sentinels]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column(batch, "_text")
            draws = np.stack([batch.column(f"_h{i}").to_numpy() for i in range(1, 5)])
            for block in blocks(data, offsets):
                part = batch.slice(block.rows.start, block.texts)
                yield _block(part, block, unit, marks, rate, spm, draws[:, block.rows])

    return run


def _block(part, block: Block, unit: str, marks: Sequence[bytes], rate: int, spm: int, draws: np.ndarray) -> pa.RecordBatch:
    index = Exceptions(block.data)
    units = Units(block, unit, index)
    cuts = np.sort(draws[:2] % (units.count + 1), axis=0)
    first, second = units.places(cuts[0]), units.places(cuts[1])
    points = index.to_points(np.stack([block.start, first, second]))
    held = block.data.tobytes()
    plain = (block.start == block.end) | (draws[2] % 100 >= rate)
    if any(mark in held for mark in marks):
        plain |= [any(held.find(m, a, b) >= 0 for m in marks) for a, b in zip(block.start.tolist(), block.end.tolist())]
    order = draws[3] % 100 < spm
    made, forms = [], []
    p, s, m = marks
    for a, b, c, d, no, turned in zip(*(x.tolist() for x in (block.start, first, second, block.end, plain, order)), strict=True):
        if no:
            made.append(held[a:d])
            forms.append("plain")
        elif turned:
            made.append(b"".join((s, held[c:d], p, held[a:b], m, held[b:c])))
            forms.append("spm")
        else:
            made.append(b"".join((p, held[a:b], s, held[c:d], m, held[b:c])))
            forms.append("psm")
    return pa.RecordBatch.from_arrays(
        [
            *(part.column(i) for i in range(part.num_columns - 5)),
            pa.array(units.count, pa.int64()),
            pa.array(forms, pa.string()),
            pa.array(points[1] - points[0], pa.int64(), mask=plain),
            pa.array(points[2] - points[1], pa.int64(), mask=plain),
            pa.array(made, pa.binary()).view(pa.string()),
        ],
        names=[*part.schema.names[:-5], "n", "form", "prefix_chars", "middle_chars", "output"],
    )


def _check(unit: str, sentinels: Sequence[str], rate: int, spm: int) -> None:
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    if not (0 <= rate <= 100 and 0 <= spm <= 100):
        raise ValueError("rate and spm are percentages")
    if len(sentinels) != 3 or len(set(sentinels)) != 3 or not all(sentinels):
        raise ValueError("three different sentinels are needed")
    for one in sentinels:
        for other in sentinels:
            if one != other and one in other or any(one.endswith(other[:k]) for k in range(1, len(other))):
                raise ValueError(f"sentinels {one} and {other} may overlap, and texts could not be restored")


def draw(seed: int, id: Column, number: int) -> Column:
    """One of the eight 32-bit draws of a row (from 1); a null id draws as an empty one."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(name, 256), 8 * number - 7, 8), 16, 10).cast("bigint")


def fill_in_middle(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    unit: str = "line",
    rate: int = 100,
    spm: int = 50,
    seed: int = 7,
    sentinels: Sequence[str] = SENTINELS,
) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every row.

    Of ``n`` units two cuts are drawn, which may fall together or at the ends. ``rate`` percent of the
    texts are rearranged, ``spm`` percent of these with the suffix first. A text that is empty or holds a
    sentinel stays as it is; its form is plain and its lengths null. A null text is empty. Draws depend
    on seed and id only, so rows that repeat an id draw alike, and a null id draws as an empty string.
    The id may have any type that casts to a string; other columns are ignored. An empty table gives none.
    """
    _check(unit, sentinels, rate, spm)
    kind = docs.schema[id].dataType.simpleString()
    drawn = docs.select(
        F.col(id).alias("_id"), F.col(text).alias("_text"), *(draw(seed, F.col(id), i).alias(f"_h{i}") for i in range(1, 5))
    )
    made = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    found = drawn.mapInArrow(_arranged(unit, tuple(sentinels), rate, spm), f"_id {kind}, {made}")
    return found.withColumnRenamed("_id", id)


def restored(form: Column, output: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text that an output of a form was made of; null where the form is none of the three."""
    p, s, m = sentinels
    last = F.substring_index(output, m, -1)
    rest = F.substring_index(output, m, 1)

    def after(mark: str, value: Column) -> Column:
        return F.substring(value, len(mark) + 1, 2**31 - 1)

    psm = F.concat(after(p, F.substring_index(rest, s, 1)), last, F.substring_index(rest, s, -1))
    spm = F.concat(F.substring_index(rest, p, -1), last, after(s, F.substring_index(rest, p, 1)))
    return F.when(form == "plain", output).when(form == "psm", psm).when(form == "spm", spm)


def digests(docs: DataFrame) -> DataFrame:
    """The contract's rows: digests of every output and of the text that is restored from it."""
    found = fill_in_middle(docs)
    back = restored(F.col("form"), F.col("output"))
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"),
    )


ORACLE = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS parts,
         sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
drawn AS (
  SELECT *, CASE WHEN t = '' OR t LIKE '%' || chr(10) THEN len(parts) - 1 ELSE len(parts) END AS n,
         ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[25:32])::BIGINT AS h4
  FROM texts),
cuts AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM drawn),
heads AS (
  SELECT *,
    CASE WHEN a = n THEN t WHEN a = 0 THEN '' ELSE array_to_string(parts[1:a], chr(10)) || chr(10) END AS one,
    CASE WHEN b = n THEN t WHEN b = 0 THEN '' ELSE array_to_string(parts[1:b], chr(10)) || chr(10) END AS two
  FROM cuts),
pieces AS (
  SELECT *, one AS p, two[length(one) + 1:] AS m, t[length(two) + 1:] AS s,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
         WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM heads)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
         ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM pieces
"""
