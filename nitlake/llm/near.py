"""Near duplicates: word shingles in common, by SimHash and by an exact prefix index.

Texts of a Jaccard similarity of 0.8 or more over word shingles are one class, and what such links chain.
SimHash gathers texts whose fingerprints differ in a few bits. What it does not gather is found exactly:
shingles have one order in all texts, and of two texts that similar the first quarters in that order share
a number of shingles that their sizes tell (:func:`least_shared`). Shingles that many texts begin with come
last in the order, so that frequent passages bring nobody together who has anything else to go by.

Texts that may be similar are gathered into groups, by links whose number is in proportion to the texts
that are filed under a shingle. A group holds sizes of two adjacent buckets only, as others cannot be
similar: else frequent passages would chain texts of all sizes to one large group. In a group the prefixes are
compared first: texts stay together if they share that number. Then the whole sets of shingles are, block by block, and of
the links found only a spanning forest is written. So neither strangers nor a large group of texts just
below the similarity cost a row for each pair.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import by_key, discard, shared_dir, stored
from .components import components
from .filters import key_filter, passes
from .simhash import cut, links, majority, shingle_hashes
from .words import Block, blocks, column, mixed, ranges

#: Pairs of just the similarity 0.8 that meet in no segment, and strangers that a text meets in all of them.
MISSED, STRANGERS = 0.05, 8
#: Texts of similarity 0.8 have shingle vectors with a cosine of 1.6 / 1.8; each bit differs with this chance.
APART = math.acos(1.6 / 1.8) / math.pi
#: Hashes that are worked on together.
TOGETHER = 100_000
#: Fingerprints of 64 bits that differ in at most this many gather their texts.
RADIUS = 4
#: Up to this many texts filed under a shingle meet pair by pair; more are one group at once.
JOINED = 32
#: Sizes of similar texts differ by a factor of 1.25 at most: in buckets this wide they are one or next to it.
WIDTH = 1.26
#: Shingles of a group, or of several small ones, that are compared in one block.
BLOCK = 1 << 18


def layout(rows: int) -> tuple[int, list[tuple[int, int]], int]:
    """(words of bits, (first bit, width) of each segment, most bits that may differ) for a number of rows.

    For an index by fingerprints alone, which finds nineteen of twenty pairs; :func:`similar` finds all
    and does not ask for it.
    """
    for width in range(12, 64):
        same = 1 - APART
        meet = same**width + width * APART * same ** (width - 1)
        parts = math.ceil(math.log(MISSED) / math.log(1 - meet))
        if parts * (width + 1) * rows <= STRANGERS * 2**width:
            break
    words = -(-parts * width // 64)
    bits = 64 * words
    # Of pairs just that similar, one in a thousand differs in more than three deviations beyond the mean.
    most = math.ceil(bits * APART + 3 * math.sqrt(bits * APART * (1 - APART)))
    return words, [(i * width, width) for i in range(bits // width)], most


def least_shared(n):
    """Shingles that the prefixes of two similar texts share at least, if the smaller has ``n``."""
    return 1 + (n - n % 20) / 20  # of numbers, arrays and columns


def prefix(n):
    """How many shingles of ``n``, the first in their order, are a text's prefix.

    Similar texts have at least ``ceil(0.8 * n)`` shingles in common. The ``least_shared``-th of these has
    all the others behind it, so it lies in the prefix of either text, and those before it do too.
    """
    return n - (4 * n + 4) // 5 + least_shared(n).astype(int)


def fewest(n: np.ndarray) -> np.ndarray:
    """Shingles that the prefix of a text of ``n`` shares at least with that of any similar text, which may be smaller."""
    return least_shared((4 * n + 4) // 5).astype(int)


def _printed(k: int):
    names = ["_id", "node", "w0", "n", "shingles"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column(batch, "_text")
            for block in blocks(data, offsets, 4 * TOGETHER):
                held, ends = block.data.tobytes(), block.offsets.tolist()
                made = [np.array(shingle_hashes(held[a:b], k), np.uint64) for a, b in itertools.pairwise(ends)]
                prints = majority(np.concatenate(made), np.array([len(m) for m in made]))
                made = [np.unique(m) for m in made]
                counts = np.array([len(m) for m in made], np.int32)
                # Texts with one set are one node.
                node = np.array([xxhash.xxh64_intdigest(m) for m in made], np.uint64)
                sets = pa.array([m.tobytes() for m in made], pa.binary())
                fixed = [pa.array(node.view(np.int64)), pa.array(prints.view(np.int64)), pa.array(counts), sets]
                yield pa.RecordBatch.from_arrays([batch.column("_id")[block.rows], *fixed], names=names)

    return run


def _begun(block: Block, often: Broadcast | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's number of shingles; the keys of its prefix, and whose they are.

    Shingles are in the order of their hashes, but those that ``often`` lets through come last.
    """
    n = np.diff(block.offsets) // 8
    key = mixed(np.frombuffer(block.data.tobytes(), np.uint64))
    if often is not None:
        late = passes(often.value, key)
        key = key[np.argsort(2 * np.repeat(np.arange(len(n)), n) + late, kind="stable")]
    size = np.where(n > 0, prefix(n), 0)
    return n, key[ranges(block.start // 8, size)], np.repeat(np.arange(len(n)), size)


def _begin(often: Broadcast | None):
    """The keys of all texts' prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column(batch, "shingles")
            for block in blocks(data, offsets, 8 * TOGETHER):
                _, key, _ = _begun(block, often)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], names=["key"])

    return run


def _prefixed(often: Broadcast, again: Broadcast):
    """Rows (node, n, keys): the keys of each text's prefix that ``again`` lets through.

    A text with fewer of them than it has to share with any similar one has no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column(batch, "shingles")
            nodes = batch.column("node").to_numpy()
            for block in blocks(data, offsets, 8 * TOGETHER):
                n, key, of = _begun(block, often)
                some = passes(again.value, key)
                held = np.bincount(of[some], minlength=len(n))
                enough = held >= fewest(n)
                key, held, n = key[some & enough[of]], held[enough], n[enough]
                ends = np.concatenate([[0], np.cumsum(8 * held)]).astype(np.int32)
                keys = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(key.tobytes())])
                fixed = [pa.array(nodes[block.rows][enough]), pa.array(n.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*fixed, keys], names=["node", "n", "keys"])

    return run


def _filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, n) from rows (node, n, keys)."""
    for batch in batches:
        data, offsets = column(batch, "keys")
        nodes, n = batch.column("node").to_numpy(), batch.column("n").to_numpy()
        for block in blocks(data, offsets, 8 * TOGETHER):
            key, of = np.frombuffer(block.data.tobytes(), np.int64), np.repeat(np.arange(block.texts), np.diff(block.offsets) // 8)
            fixed = pa.array(key), pa.array(nodes[block.rows][of]), pa.array(n[block.rows][of])
            yield pa.RecordBatch.from_arrays(list(fixed), names=["key", "node", "n"])


def _wanted(nodes: Broadcast):
    """The sets of texts whose node the filter lets through, one for each node and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            node = batch.column("node").to_numpy()
            keep = passes(nodes.value, node.view(np.uint64))
            for i in np.flatnonzero(keep).tolist():
                keep[i] = node[i] not in seen
                seen.add(node[i])
            yield batch.select(["node", "shingles"]).filter(pa.array(keep))

    return run


def _forest(node: np.ndarray, n: np.ndarray, sets: list[np.ndarray], whole: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that join the texts as all pairs do whose sets have four fifths of their union in common.

    Such texts share one of the rarest fifth of their shingles, so no others are compared. Where the sets
    are not ``whole`` but of prefixes, links join texts that share as many as similar ones of their sizes do.
    """
    size = np.array([len(s) for s in sets])
    start = np.cumsum(size) - size
    _, codes, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    codes = codes[np.lexsort((codes, counts[codes], np.repeat(np.arange(len(sets)), size)))]
    rare = np.where(size > 0, np.maximum(size - ((4 * n + 4) // 5 if whole else fewest(n)) + 1, 0), 0)
    filed = codes[ranges(start, rare)]
    under = np.repeat(np.arange(len(sets)), rare)[np.argsort(filed, kind="stable")]
    filed = np.bincount(filed, minlength=len(counts))
    first = np.cumsum(filed) - filed
    marked, free = np.zeros(len(counts), bool), np.ones(len(sets), bool)
    for root in range(len(sets)):
        queue = [root] if free[root] else []
        free[root] = False
        while queue:
            one = queue.pop()
            own = codes[start[one] : start[one] + size[one]]
            some = own[: rare[one]]
            some = some[filed[some] > 1]
            if not len(some):
                continue
            met = under[ranges(first[some], filed[some])]
            met = np.unique(met[free[met]])
            met = met[(5 * n[met] >= 4 * n[one]) & (4 * n[met] <= 5 * n[one])]
            if not len(met):
                continue
            marked[own] = True
            both = np.add.reduceat(marked[codes[ranges(start[met], size[met])]], np.cumsum(size[met]) - size[met], dtype=np.int64)
            marked[own] = False
            least = 4 * (n[one] + n[met]) / 9 if whole else least_shared(np.minimum(n[one], n[met]))
            found = met[both >= least]
            if len(found):
                free[found] = False
                queue.extend(found.tolist())
                yield np.full(len(found), node[root]), node[found]


def _linked(whole: bool):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["root", "one", "two", "node"])
        group = frame[["root", "one", "two"]].to_numpy()
        node, n, sets = frame["node"].to_numpy(), frame["n"].to_numpy(np.int64), [np.frombuffer(s, np.uint64) for s in frame["shingles"]]
        cuts = np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1
        found = [
            (np.full(len(pair[0]), group[a, 0]), *pair)
            for a, b in zip([0, *cuts], [*cuts, len(node)], strict=True)
            for pair in _forest(node[a:b], n[a:b], sets[a:b], whole)
        ]
        root, a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        return pd.DataFrame({"root": root, "a": a, "b": b})

    return run


def _alike_sizes(one: Column, other: Column) -> Column:
    return (4 * one <= 5 * other) & (4 * other <= 5 * one)


def _bucket(n: Column) -> Column:
    return F.floor(F.log(F.greatest(n, F.lit(1))) / math.log(WIDTH)).cast("int")


def _gathered(hashed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b, window): links that bring all similar texts, and some others, into groups; (node, n, keys): the
    prefixes of texts that may have a similar one; both stored.

    A window is a bucket of sizes and the one below it; similar texts are in the window of the larger one.
    """
    sets = hashed.select("node", "shingles")
    begin = lambda often: sets.mapInArrow(_begin(often), "key bigint")
    number = lambda rows: rows.groupBy("key").agg(F.count("*").alias("rows"))
    many = stored(number(begin(None)).where(F.col("rows") > JOINED).select("key"), "often")
    often = key_filter(many, "key", many.count())
    twice = stored(number(begin(often)).where("rows > 1").select("key"), "again")
    again = key_filter(twice, "key", twice.count())
    kept = sets.mapInArrow(_prefixed(often, again), "node bigint, n int, keys binary").groupBy("node")
    prefixes = stored(kept.agg(F.first("n").alias("n"), F.first("keys").alias("keys")), "prefixes")
    filed = stored(prefixes.mapInArrow(_filed, "key bigint, node bigint, n int"), "filed")
    sizes = stored(number(filed).where("rows > 1"), "sizes")
    # Texts under a frequent shingle are one group in each window that adds a text to the one below it.
    # Others have to share as many as similar texts do: those that meet under no frequent shingle share
    # them all under shingles that are joined here.
    hot = filed.join(by_key(sizes.where(F.col("rows") > JOINED).select("key")), "key").withColumn("bucket", _bucket(F.col("n")))
    hot = hot.withColumn("window", F.explode(F.array("bucket", F.col("bucket") + 1)))
    lows = hot.groupBy("key", "window").agg(F.min("node").alias("low"), F.max("bucket").alias("top")).where("top = window")
    hot = hot.join(by_key(lows), ["key", "window"]).where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b"), "window")
    few = filed.join(by_key(sizes.where(F.col("rows") <= JOINED).select("key")), "key")
    a, b = (few.withColumnsRenamed({"node": side, "n": f"{side}_n"}) for side in "ab")
    met = a.join(by_key(b), "key").where((F.col("a") < F.col("b")) & _alike_sizes(F.col("a_n"), F.col("b_n")))
    sides = F.first("a_n"), F.first("b_n")
    shared = met.groupBy("a", "b").agg(F.count("*").alias("shared"), F.least(*sides).alias("n"), F.greatest(*sides).alias("larger"))
    cold = shared.where(F.col("shared") >= least_shared(F.col("n"))).select("a", "b", _bucket(F.col("larger")).alias("window"))
    found = stored(cold.unionByName(hot.distinct()), "gathered")
    often.destroy()
    again.destroy()
    discard(many, twice, filed, sizes)
    return found, prefixes


def _windowed(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, window) of the links between texts whose sizes lie in one window."""
    for side in "ab":
        sized = nodes.select(F.col("node").alias(side), _bucket(F.col("n")).alias(f"{side}_bucket"))
        links = links.join(by_key(sized), side)
    links = links.where(F.abs(F.col("a_bucket") - F.col("b_bucket")) <= 1)
    return links.select("a", "b", F.greatest("a_bucket", "b_bucket").alias("window"))


def _groups(links: DataFrame, name: str) -> DataFrame:
    """(root, node): the texts that the links (a, b, window) chain, window by window; a text may be in several."""
    inside = [F.xxhash64(side, "window").alias(f"{side}_inside") for side in "ab"]
    links = stored(links.select("a", "b", *inside), f"{name}-inside")
    places = [links.select(F.col(side).alias("node"), F.col(f"{side}_inside").alias("inside")) for side in "ab"]
    found = components(links, "a_inside", "b_inside").withColumnRenamed("node", "inside")
    groups = stored(found.join(by_key(places[0].unionByName(places[1]).distinct()), "inside").select("root", "node"), name)
    discard(links)
    return groups


def _compared(groups: DataFrame, sizes: DataFrame, sets: DataFrame, whole: bool) -> DataFrame:
    """(root, a, b): links that join the texts of each group as all their similar pairs do; stored.

    ``sizes`` has (node, n, held), what is ``held`` of a text's ``n`` shingles in (node, shingles); if that
    is not the ``whole`` set but the prefix, links join texts that may be similar.
    """
    sized = groups.join(by_key(sizes), "node")
    count = F.greatest(F.ceil(F.sum("held") / BLOCK), F.lit(1)).cast("int").alias("blocks")
    placed = stored(sized.join(by_key(sized.groupBy("root").agg(count)), "root"), "placed" if whole else "begun")
    deals = (placed.agg(F.sum("held")).first()[0] or 0) // BLOCK + 1
    wanted = key_filter(placed, "node", placed.count())
    sets = sets.mapInArrow(_wanted(wanted), "node bigint, shingles binary")
    sets = sets.groupBy("node").agg(F.first("shingles").alias("shingles"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    every = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda other: F.struct(F.least(block, other).alias("one"), F.greatest(block, other).alias("two")),
    )
    # Small groups are dealt out many at a time; a large one has a deal for each pair of its blocks.
    deal = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(deals))).otherwise(F.xxhash64("root", "one", "two"))
    dealt = sets.join(by_key(placed), "node").select("root", "node", "n", "blocks", "shingles", F.inline(every))
    dealt = dealt.select(deal.alias("deal"), "root", "one", "two", "node", "n", "shingles")
    links = dealt.groupBy("deal").applyInPandas(_linked(whole), "root bigint, a bigint, b bigint")
    found = stored(links, "alike" if whole else "likely")
    wanted.destroy()
    discard(placed)
    return found


def similar(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = 5) -> DataFrame:
    """(id, component_id) of every row: classes of texts 0.8 similar or more over ``k``-word shingles.

    Texts are lower-cased (A-Z) and split at white space; repeats of a shingle count once in the
    similarity. All texts that are as similar are linked, others are not, and classes chain links.
    ``component_id`` is the smallest id of the class, of any type that Spark orders. Texts without words
    (null, empty, white) are one class; a text of fewer than ``k`` words is one shingle. Rows that repeat
    an id are told apart by their texts. Other columns are ignored, and an empty table gives none.
    The work on a group of texts of one size that may be similar and are not grows with the square of its
    size, and so does what is dealt of it; neither its links nor the memory of a task do.
    """
    shared_dir(docs.sparkSession)
    rows = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    hashed = stored(rows.mapInArrow(_printed(k), f"_id {kind}, node bigint, w0 bigint, n int, shingles binary"), "prints")
    # Texts of one set may differ in how often a shingle repeats, and so in their fingerprints.
    same = hashed.groupBy("node").agg(F.min("_id").alias("least"), F.min("w0").alias("w0"), F.min("n").alias("n"))
    nodes = stored(same, "nodes")

    prints = links(nodes.select("node", "w0"), RADIUS, cut("w0", RADIUS, nodes.count()))
    gathered, prefixes = _gathered(hashed)
    met = _groups(_windowed(prints, nodes).unionByName(gathered), "met")
    # Most texts of a group share a few frequent shingles only. Prefixes tell so, a small part of the sets.
    begun = prefixes.select("node", "n", (F.length("keys") / 8).cast("int").alias("held"))
    likely = _compared(met, begun, prefixes.select("node", F.col("keys").alias("shingles")), whole=False)
    groups = _groups(likely.select("a", "b", F.col("root").alias("window")), "groups")
    discard(gathered, prefixes, met, likely)
    found = _compared(groups, nodes.select("node", "n", F.col("n").alias("held")), hashed.select("node", "shingles"), whole=True)

    linked = stored(components(found).join(by_key(nodes.select("node", "least")), "node"), "linked")
    smallest = linked.groupBy("root").agg(F.min("least").alias("smallest"))
    named = linked.select("node", "root").join(by_key(smallest), "root").select("node", "smallest")
    own = nodes.select("node", "least").join(by_key(named), "node", "left")
    own = own.select("node", F.coalesce("smallest", "least").alias("component_id"))
    made = hashed.select("_id", "node").join(by_key(own), "node")
    # The sets are as large as the texts, so they go before anything else is done with the classes.
    classes = stored(made.select(F.col("_id").alias(id), "component_id"), "classes")
    discard(hashed, nodes, groups, found, linked)
    return classes
