"""Common lines beside a plain version; the minimal perfect hash by itself."""

from collections import defaultdict

import numpy as np
import pytest
from helpers import clashing, odd, odd_rows, rows_of, small
from nitlake.llm import lines
from nitlake.llm.perfect import Perfect

WHITE = " \t\n\v\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, chars=40, docs=5):
    """(id, text that stays, lines, dropped) of (id, text) rows; a null id is the smallest."""
    size = lambda i: -(2**63) if i is None else i
    keyed = [[(line, line.strip(WHITE).translate(LOWER)) for line in (t or "").split("\n")] for _, t in rows]
    holds, latest = defaultdict(int), defaultdict(lambda: -(2**63))
    for (i, _), cut in zip(rows, keyed):
        for key in {k for _, k in cut}:
            holds[key] += 1
            latest[key] = max(latest[key], size(i))
    out = []
    for (i, _), cut in zip(rows, keyed):
        stay = [line for line, k in cut if len(k) < chars or holds[k] < docs or size(i) >= latest[k]]
        out.append((i, "\n".join(stay), len(cut), len(cut) - len(stay)))
    return sorted(out, key=repr)


def made(seed=3):
    rng = np.random.default_rng(seed)
    pool = [" ".join(rng.choice(["Über", "river", "Bridge", "日本", "naïve", "end."], 9)) for _ in range(30)]
    pool += ["", " ", "\t", "short", "x" * 39, "x" * 40, "é" * 39, "é" * 40, " " + "y" * 39, "z" * 40 + "\x85"]
    rows = []
    for i in range(200):
        cut = [pool[k] for k in rng.integers(0, len(pool), rng.integers(0, 9))]
        cut = [rng.choice(["", " ", "\t\r", "\v"]) + (c.upper() if rng.random() < 0.2 and c.isascii() else c) + rng.choice(["", "  "]) for c in cut]
        rows.append((int(i // 1.5), "\n".join(cut)))
    return rows + [(i, t) for i, t, *_ in odd_rows()] + [(None, pool[0]), (None, None)]


@pytest.mark.parametrize("shard,held", [(lines.SHARD, lines.HELD), (3, lines.HELD), (4, 1)])
def test_beside_a_plain_version(spark, shard, held):
    """One shard, many shards, and a pass for each of several shards: the same rows."""
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    for chars, least in ((40, 5), (1, 2)):
        want = plain(rows, chars, least)
        assert any(r[3] for r in want)
        got = lines.without_common_lines(docs, least_chars=chars, least_docs=least, shard=shard, held=held)
        assert rows_of(got) == want


def test_every_line_goes(spark):
    line = "the same line of more than forty characters in all"
    rows = [(i, "\n".join([line] * (i % 3 + 1))) for i in range(9)] + [(8, line)]
    got = rows_of(lines.without_common_lines(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert got == plain(rows) and [t for i, t, *_ in got if t] == [line, "\n".join([line] * 3)]


def test_table_and_other_columns(spark):
    docs = small(spark)
    want = plain([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert rows_of(lines.without_common_lines(docs)) == want
    assert rows_of(lines.digests(clashing(odd(spark)))) == rows_of(lines.digests(odd(spark)))
    assert lines.digests(odd(spark).limit(0)).collect() == []


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    one, two = rng.integers(0, 2**63, (2, n)).astype(np.uint64)
    one[: n // 2] = one[:1]  # keys that share a half are different keys all the same
    perfect = Perfect.build(one, two)
    assert sorted(perfect.slots(one, two).tolist()) == list(range(n))
    others = perfect.slots(*rng.integers(0, 2**63, (2, 100)).astype(np.uint64))
    assert others.min() >= -1 and others.max() < max(n, 1)
    assert 64 * len(perfect.words) <= 5 * n + 1000
