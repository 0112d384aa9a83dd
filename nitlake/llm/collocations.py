"""Phrases whose words stand together more often than apart, by dynamic itemset counting.

The corpus is dealt into SHARDS that are scanned in turn, again and again. Words are counted from the
first scan on. As soon as both the first and the last L - 1 words of a phrase of L words have been seen
often enough, however few shards that took, the phrase is counted too, from the next scan on. Every word
and phrase is counted for one full cycle, each shard once, whenever it started; so counts are those of the
whole corpus, and no phrase that is frequent is missed, since its parts are at least as frequent and start
it before they are done themselves. Scans of several lengths are the same scan.

What has become frequent is kept as bits of a map of bounded size, one for each scan. A phrase starts
with the first scan in whose map the bits of both its parts (and of theirs) are set, and is over when they
were set a cycle ago; both are read off two maps where the text is, and no candidates are made up. Bits
are never taken back. Those that two phrases share start one of them early, or in vain, but never for
less or more than one cycle.

A scan's counts go to buckets of the phrases' hashes as sorted arrays, and are merged there with what the
bucket holds. A bucket forgets what is not frequent after its cycle. Buckets grow in number with the
corpus; the largest thing in one place is a bucket, or a map of 8 MB.

Words and phrases are told apart by 62 bits of hash and their length.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, shared_dir, stored
from .filters import passes
from .words import Block, Rolling, blocks, column, mixed, ranges

LEAST = 30
LONGEST = 4
SHARDS = 4
SHARE = 80
TOP = 2000
#: Rows in a row that go to the same shard.
DEALT = 64
#: Bytes of text for each bucket of counts: three million words at most, fifty megabytes of arrays.
GRAIN = 16_000_000
#: Hashes that a task gathers before it sorts, counts and sends them.
GATHERED = 1 << 22
#: A map of what is frequent has at most 2^26 bits.
MOST_BITS = 26

_ODD = np.uint64(0x9E3779B97F4A7C15)
_LENGTH = np.uint64(3)
_NEVER = np.iinfo(np.uint16).max
_SENT = "bucket int, keys binary, counts binary"
_STATE = f"{_SENT}, firsts binary, steps binary, reached binary"
_NAMED = "len int, k bigint, p bigint, s bigint, lang string, word string, n bigint"


def _classes() -> np.ndarray:
    """What each byte becomes: lower case; blanks and tabs a blank; signs that end a piece a line end."""
    made = np.arange(256, dtype=np.uint8)
    made[65:91] += 32
    made[0x09] = 0x20
    made[0x0A:0x0E] = 0x0A
    made[list(b".,;:!?")] = 0x0A
    return made


_CLASSES = _classes()


class Phrases:
    """The words of a block, and of each place the hash of the phrase of any length that begins there.
    The lowest two bits of a hash are the number of words less one."""

    def __init__(self, block: Block, seeds: np.ndarray):
        self.block = Block(_CLASSES[block.data], block.offsets, block.rows)
        self.start, self.end, self.text = self.block.words()
        spans = Rolling(self.block.data, 21).spans(self.start, self.end)
        self.words = mixed(spans + seeds[block.rows][self.text] * _ODD) & ~_LENGTH
        piece = np.cumsum(self.block.data == 0x0A)[self.start] if len(self.start) else self.start
        self.joined = (self.text[1:] == self.text[:-1]) & (piece[1:] == piece[:-1])

    def longer(self, shorter: np.ndarray, length: int) -> np.ndarray:
        """Hashes of ``length`` words from those of one word less."""
        return (mixed(shorter[:-1] * _ODD + self.words[length - 1 :]) & ~_LENGTH) | np.uint64(length - 1)

    def spelt(self, at: np.ndarray) -> pa.Array:
        """The words at some places as strings."""
        sizes = self.end[at] - self.start[at]
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        data = self.block.data[ranges(self.start[at], sizes)]
        return pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)])

    def active(self, longest: int, now: np.ndarray, before: np.ndarray | None):
        """(length, keys, keys of one word less, where) for each length from two: the hashes at each place,
        and the places whose phrase, its parts, their parts and so on are all in the map ``now``, and were
        not all in the map ``before``."""
        shorter = self.words
        valid, over = np.ones(len(shorter), bool), np.full(len(shorter), before is not None)
        for length in range(2, longest + 1):
            often = valid & passes(now, shorter)
            pairs = often[:-1] & often[1:]
            if length == 2:
                pairs &= self.joined
            if not pairs.any():
                return
            if before is not None:
                over = over & passes(before, shorter)
            over = over[:-1] & over[1:]
            keys = self.longer(shorter, length)
            yield length, keys, shorter, np.flatnonzero(pairs & ~over)
            shorter, valid = keys, pairs


def _summed(keys: np.ndarray, *columns: tuple[np.ufunc, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Sorted different keys, and each column reduced over the rows of a key."""
    if not len(keys):
        return keys, *(held for _, held in columns)
    order = np.argsort(keys, kind="stable")
    held = keys[order]
    begin = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
    return held[begin], *(how.reduceat(values[order], begin) for how, values in columns)


def _sent(gathered: list[np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    """Counts of hashes as sorted arrays, one row for each bucket that has any."""
    keys = np.sort(np.concatenate(gathered))
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts = np.diff(np.append(begin, len(keys))).astype("<u4")
    keys = keys[begin]
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist()
    for few in range(0, len(first), 64):
        cuts = [*first[few : few + 64], *(first[few + 64 : few + 65] or [len(keys)])]
        spans = list(zip(cuts[:-1], cuts[1:], strict=True))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(bucket[cuts[:-1]].astype(np.int32)),
                *(pa.array([held[a:b].tobytes() for a, b in spans], pa.binary()) for held in (keys, counts)),
            ],
            names=["bucket", "keys", "counts"],
        )


def _scanned(words: bool, longest: int, buckets: int, maps: Broadcast):
    """Counts of one shard: its words if ``words``, and the phrases that are in their cycle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, before = maps.value
        gathered, size = [], 0
        for batch in batches:
            seeds = batch.column("seed").to_numpy().view(np.uint64)
            for block in blocks(*column(batch, "text")):
                found = Phrases(block, seeds)
                some = [found.words] if words and len(found.words) else []
                if now is not None and len(found.words):
                    some += [keys[at] for _, keys, _, at in found.active(longest, now, before)]
                gathered += some
                size += sum(map(len, some))
                if size >= GATHERED:
                    yield from _sent(gathered, buckets)
                    gathered, size = [], 0
        if size:
            yield from _sent(gathered, buckets)

    return run


def _held(table: pa.Table, name: str, kind: str) -> np.ndarray:
    parts = [np.frombuffer(v.as_buffer(), kind) for v in table.column(name) if v.is_valid]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _merged(scan: int, shards: int, least: int, longest: int):
    """A bucket's counts with those of a scan; ``reached`` are the keys that became frequent with it."""

    def run(old: pa.Table, new: pa.Table) -> pa.Table:
        bucket = (old if old.num_rows else new).column("bucket")[0].as_py()
        keys, counts = _summed(_held(new, "keys", "<u8"), (np.add, _held(new, "counts", "<u4").astype(np.int64)))
        keys, counts, firsts, steps = _summed(
            np.concatenate([_held(old, "keys", "<u8"), keys]),
            (np.add, np.concatenate([_held(old, "counts", "<i8"), counts])),
            (np.minimum, np.concatenate([_held(old, "firsts", "<u2"), np.full(len(keys), scan, np.uint16)])),
            (np.minimum, np.concatenate([_held(old, "steps", "<u2"), np.full(len(keys), _NEVER, np.uint16)])),
        )
        often = counts >= least
        steps[often & (steps == _NEVER)] = scan
        stay = often | (scan < firsts.astype(np.int64) + shards - 1)
        news = keys[(steps == scan) & ((keys & _LENGTH).astype(np.int64) < longest - 1)]
        row = [keys[stay], counts[stay], firsts[stay], steps[stay], news]
        names = [c.split()[0] for c in _STATE.split(", ")]
        return pa.table([pa.array([bucket], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in row)], names=names)

    return run


def _unpacked(least: int | None):
    """Rows of the keys that a scan made frequent, or of all that are frequent with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if least is None:
                yield pa.RecordBatch.from_arrays([pa.array(_held(table, "reached", "<i8"))], names=["k"])
                continue
            counts = _held(table, "counts", "<i8")
            often = counts >= least
            made = [pa.array(_held(table, "keys", "<i8")[often]), pa.array(counts[often])]
            yield pa.RecordBatch.from_arrays(made, names=["k", "a"])

    return run


def _marked(keys: DataFrame, bits: int) -> np.ndarray:
    """A map of 2^bits bits with the leading bits of each key set; the driver sees its words only."""
    place = F.shiftrightunsigned(F.col("k"), 64 - bits)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(63)).cast("int"))
    words = keys.select(F.shiftrightunsigned(place, 6).cast("int").alias("word"), bit.alias("bit"))
    made = np.zeros(1 << (bits - 6), np.uint64)
    for batch in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow().to_batches():
        made[batch.column("word").to_numpy()] = batch.column("bits").to_numpy().view(np.uint64)
    return made


class Shards:
    """Texts written once by shard; which shard a text is in does not matter to any result."""

    def __init__(self, docs: DataFrame, text: str, lang: str, shards: int):
        named = F.coalesce(F.col(lang).cast("string"), F.lit("und"))
        number = F.monotonically_increasing_id()
        run = F.floor(number.bitwiseAND(F.lit((1 << 33) - 1)) / DEALT)
        rows = docs.select(
            F.col(text).alias("text"), named.alias("lang"), F.xxhash64(named).alias("seed"), F.octet_length(text).alias("size"),
            F.pmod(F.shiftright(number, 33) + run, F.lit(shards)).cast("int").alias("shard"),
        )
        self.spark, self.number = docs.sparkSession, shards
        self.table = stored_by(rows, "shard")
        self.bytes = self.table.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]

    def shard(self, scan: int) -> DataFrame:
        return self.table.where(F.col("shard") == scan % self.number).select("text", "seed")


def stored_by(rows: DataFrame, column: str) -> DataFrame:
    """As ``stored``, in one folder for each value of a column."""
    spark = rows.sparkSession
    place = f"{shared_dir(spark)}/dealt-{uuid.uuid4().hex}"
    rows.write.partitionBy(column).parquet(place)
    table = spark.read.schema(rows.schema).parquet(place)
    table._nitlake_place = place
    return table


def counted(texts: Shards, least: int = LEAST, longest: int = LONGEST, grain: int = GRAIN) -> tuple[DataFrame, int]:
    """The buckets after the last scan, a stored table, and how many bits a map of its keys has."""
    spark, shards = texts.spark, texts.number
    buckets = max(1, -(-texts.bytes // grain))
    bits = int(np.clip((int(texts.bytes) >> 5).bit_length(), 10, MOST_BITS))
    state = spark.createDataFrame([], _STATE)
    maps = [np.zeros(1 << (bits - 6), np.uint64)]
    scan = 0
    while True:
        now, before = maps[-1], maps[0] if scan >= shards else None
        if before is not None and (now == before).all():
            return state, bits
        sent = spark.sparkContext.broadcast((now if now.any() else None, before))
        found = texts.shard(scan).mapInArrow(_scanned(scan < shards, longest, buckets, sent), _SENT)
        both = state.groupBy("bucket").cogroup(found.groupBy("bucket"))
        after = stored(both.applyInArrow(_merged(scan, shards, least, longest), _STATE), "phrases")
        sent.destroy()
        if scan:
            discard(state)
        state = after
        reached = state.select("reached").mapInArrow(_unpacked(None), "k bigint")
        # The maps before the scans of one cycle, and before the next.
        maps = [*maps[-shards:], now | _marked(reached, bits)]
        scan += 1


def _naming(longest: int, frequent: Broadcast):
    """Names of the words and parts of the phrases that the map holds, each once per task or so, as rows
    of _NAMED; and, as rows of length 0, how many words each language has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = frequent.value
        seen = np.zeros(0, np.uint64)
        for batch in batches:
            seeds = batch.column("seed").to_numpy().view(np.uint64)
            langs = batch.column("lang")
            for block in blocks(*column(batch, "text")):
                found = Phrases(block, seeds)
                if not len(found.words):
                    continue
                row = pa.array(found.text + block.rows.start)
                _, n, at = _summed(seeds[row], (np.add, np.ones(len(row), np.int64)), (np.minimum, np.arange(len(row))))
                yield _named(0, seeds[row][at], None, None, langs.take(row.take(pa.array(at))), None, n)
                levels = [(1, found.words, None, np.arange(len(found.words)))]
                for length, keys, shorter, at in (*levels, *found.active(longest, held, None)):
                    at = at[passes(held, keys[at])]
                    key, at = _summed(keys[at], (np.minimum, at))
                    new = ~_among(key, seen)
                    key, at = key[new], at[new]
                    seen = np.sort(np.concatenate([seen, key])) if len(seen) < GATHERED else key
                    one = np.ones(len(key), np.int64)
                    if length == 1:
                        yield _named(1, key, None, None, langs.take(row.take(pa.array(at))), found.spelt(at), one)
                    else:
                        yield _named(length, key, shorter[at], shorter[at + 1], None, None, one)

    return run


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys are in a sorted array."""
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def _named(length: int, k, p, s, lang, word, n) -> pa.RecordBatch:
    size = len(n)
    numbers = [pa.nulls(size, pa.int64()) if x is None else pa.array(x.view(np.int64)) for x in (k, p, s)]
    texts = [pa.nulls(size, pa.string()) if x is None else x for x in (lang, word)]
    names = [c.split()[0] for c in _NAMED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(np.full(size, length, np.int32)), *numbers, *texts, pa.array(n)], names=names)


def counts(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    least: int = LEAST,
    longest: int = LONGEST,
    shards: int = SHARDS,
    grain: int = GRAIN,
) -> DataFrame:
    """(len, k, p, s, lang, word, a) of all words and phrases of up to ``longest`` words that occur
    ``least`` times or more in a language, and one row of length 0 per language with all its words.

    ``k`` is the hash, ``p`` and ``s`` those of the first and last words without one; ``lang`` and
    ``word`` are given for single words. A phrase whose parts are not frequent (its hash is that of
    another) is not among them. The table is stored.
    """
    if not 2 <= longest <= 4:
        raise ValueError("phrases have two to four words")
    texts = Shards(docs, text, lang, shards)
    state, bits = counted(texts, least, longest, grain)
    frequent = stored(state.mapInArrow(_unpacked(least), "k bigint, a bigint"), "phrases")
    sent = docs.sparkSession.sparkContext.broadcast(_marked(frequent.select("k"), bits))
    rows = texts.table.select("text", "lang", "seed").mapInArrow(_naming(longest, sent), _NAMED)
    names = rows.groupBy("len", "k", "p", "s", "lang", "word").agg(F.sum("n").alias("n"))
    found = names.join(frequent, "k", "left").where("len = 0 OR a IS NOT NULL")
    found = found.select("len", "k", "p", "s", "lang", "word", F.when(F.col("len") == 0, F.col("n")).otherwise(F.col("a")).alias("a"))
    made = stored(found, "phrases")
    sent.destroy()
    discard(state, frequent, texts.table)
    return made


def phrases(frequent: DataFrame, longest: int = LONGEST) -> list[DataFrame]:
    """Per length, (k, p, s, lang, phrase, a, heads, tails): ``heads`` are the counts of the first 1, 2,
    ... words, ``tails`` of the last ones. Each length is put together from the one before and stored."""
    one = F.array("a")
    words = frequent.where("len = 1")
    levels = [words.select("k", "p", "s", "lang", F.col("word").alias("phrase"), "a", one.alias("heads"), one.alias("tails"))]
    for length in range(2, longest + 1):
        shorter = levels[-1]
        first = shorter.select(F.col("k").alias("p"), "lang", F.col("phrase").alias("begin"), "heads")
        last = shorter.select(F.col("k").alias("s"), F.substring_index("phrase", " ", -1).alias("close"), "tails")
        rows = frequent.where(F.col("len") == length).select("k", "p", "s", "a").join(first, "p").join(last, "s")
        made = rows.select(
            "k", "p", "s", "lang", F.concat_ws(" ", "begin", "close").alias("phrase"), "a",
            F.concat("heads", F.array("a")).alias("heads"), F.concat("tails", F.array("a")).alias("tails"),
        )
        levels.append(stored(made, "phrases"))
    return levels


def _worst_cut(length: int) -> Column:
    """The cut with the lowest score, the shortest first part at ties: (score, words, l, r)."""
    cuts = []
    for words in range(1, length):
        l, r = F.get("heads", F.lit(words - 1)), F.get("tails", F.lit(length - words - 1))
        # Decimals of 38 digits, as the product may pass 64 bits.
        score = F.expr(f"CAST(2000000 AS DECIMAL(18, 0)) * CAST(a AS DECIMAL(19, 0)) DIV (heads[{words - 1}] + tails[{length - words - 1}])")
        cuts.append(F.struct(score.alias("score"), F.lit(words).alias("words"), l.alias("l"), r.alias("r")))
    return F.array_min(F.array(*cuts))


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    least: int = LEAST,
    longest: int = LONGEST,
    share: int = SHARE,
    top: int = TOP,
    shards: int = SHARDS,
    grain: int = GRAIN,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of every language.

    Texts are lower-cased (A-Z) and cut into pieces at the signs ``.,;:!?`` and line ends, pieces into
    words at blanks and tabs. A phrase of 2 to ``longest`` words that occurs ``a`` >= ``least`` times has
    the score floor(2000000 a / (l + r)) of its worst cut into parts that occur l and r times; n counts the
    language's words. It goes if a longer candidate that holds it occurs ``share`` percent as often or more.
    Ties in score and ``a`` are settled by the phrase's bytes. A null or empty text has no words, a null
    language is ``und``, repeated rows count again, other columns (also doc_id) are ignored; an empty
    table gives no rows. Only the report's length is limited.
    """
    return ranked(counts(docs, text, lang, least, longest, shards, grain), longest, share, top)


def ranked(frequent: DataFrame, longest: int = LONGEST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """The report of :func:`collocations` from the table of :func:`counts`."""
    levels = phrases(frequent, longest)
    scored, holders = [], []
    for length in range(2, longest + 1):
        level = levels[length - 1]
        scored.append(level.select("k", "lang", "phrase", "a", _worst_cut(length).alias("cut")))
        if length > 2:  # a phrase that holds another also holds one word more of it than that other
            holders.append(level.select(F.explode(F.array("p", "s")).alias("k"), F.col("a").alias("longer")))
    candidates = scored[0]
    for other in scored[1:]:
        candidates = candidates.unionByName(other)
    if holders:
        held = holders[0]
        for other in holders[1:]:
            held = held.unionByName(other)
        held = held.groupBy("k").agg(F.max("longer").alias("longer"))
        candidates = candidates.join(held, "k", "left").where(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True)))
    best = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    first = candidates.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    total = frequent.where("len = 0").select("lang", F.col("a").alias("n"))
    return first.join(total, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"),
        "n", F.col("cut.score").alias("score"),
    )


ORACLE = r"""
WITH texts AS (
  SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (
  SELECT row, lang, string_split_regex(t, '[.,;:!?\x0A-\x0D]') AS list FROM texts),
piece AS (SELECT row, lang, unnest(list) AS body, generate_subscripts(list, 1) AS piece FROM pieces),
listed AS (SELECT row, lang, piece, regexp_extract_all(body, '[^\x20\x09]+') AS ws FROM piece),
tokens AS (SELECT row, lang, piece, unnest(ws) AS one, generate_subscripts(ws, 1) AS place FROM listed),
totals AS (SELECT lang, count(*)::BIGINT AS n FROM tokens GROUP BY lang),
runs AS (
  SELECT lang, one, lead(one, 1) OVER w AS two, lead(one, 2) OVER w AS three, lead(one, 3) OVER w AS four
  FROM tokens WINDOW w AS (PARTITION BY row, piece ORDER BY place)),
grams AS (
  SELECT lang, one AS phrase FROM runs
  UNION ALL SELECT lang, one || ' ' || two FROM runs WHERE two IS NOT NULL
  UNION ALL SELECT lang, one || ' ' || two || ' ' || three FROM runs WHERE three IS NOT NULL
  UNION ALL SELECT lang, one || ' ' || two || ' ' || three || ' ' || four FROM runs WHERE four IS NOT NULL),
f AS (
  SELECT lang, phrase, string_split(phrase, ' ') AS words, count(*)::BIGINT AS a
  FROM grams GROUP BY lang, phrase HAVING count(*) >= 30),
split AS (
  SELECT lang, phrase, a, k, array_to_string(words[1:k], ' ') AS head, array_to_string(words[k + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, len(words))) AS k FROM f)),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, (2000000::HUGEINT * c.a) // (x.a + y.a) AS score
  FROM split c JOIN f x ON x.lang = c.lang AND x.phrase = c.head JOIN f y ON y.lang = c.lang AND y.phrase = c.tail),
worst AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS pick FROM cuts),
inner_parts AS (
  SELECT lang, a, array_to_string(words[i:i + n - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, len(words) - n + 2)) AS i FROM (SELECT *, unnest(range(2, len(words))) AS n FROM f))),
held AS (SELECT lang, phrase, max(a) AS longer FROM inner_parts GROUP BY lang, phrase),
kept AS (
  SELECT w.* FROM worst w LEFT JOIN held h ON h.lang = w.lang AND h.phrase = w.phrase
  WHERE pick = 1 AND (h.longer IS NULL OR 100 * h.longer < 80 * w.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, r.rank::BIGINT AS rank, r.phrase, r.a, r.l, r.r, t.n, r.score::BIGINT AS score
FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000
"""
