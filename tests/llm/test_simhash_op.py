import re

import numpy as np
import pytest
import xxhash
from helpers import SMALL, clashing, odd, odd_rows, rows_of, small
from nitlake.llm import queries, simhash
from pyspark.sql import functions as F


def fingerprint(text, k=4):
    text = (text or "").translate({i: i + 32 for i in range(65, 91)})
    words = re.findall("[^\x20\x09-\x0d]+", text)
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, radius=4):
    prints = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, (own, _) in enumerate(rows):
        if own is not None:
            least[find(i)] = min(least.get(find(i), own), own)
    return sorted(((own, f"{prints[i]:016x}", least.get(find(i))) for i, (own, _) in enumerate(rows)), key=repr)


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in small(spark).collect()]
    assert rows_of(queries.QUERIES["op6_simhash"](spark, SMALL)) == brute(rows)


def test_odd_rows(spark):
    want = brute([(i, t) for i, t, *_ in odd_rows()])
    assert rows_of(simhash.near_duplicates(odd(spark))) == want
    assert rows_of(simhash.near_duplicates(clashing(odd(spark)))) == want
    assert rows_of(simhash.near_duplicates(odd(spark).limit(0))) == []
    assert len(rows_of(simhash.similar(odd(spark)))) == len(want)


def cluster(rng, size, flips):
    base = int(rng.integers(1 << 62))
    return {base ^ sum(1 << int(b) for b in rng.choice(12, rng.integers(0, flips), replace=False)) for _ in range(size)}


@pytest.mark.parametrize(("joined", "block"), [(128, 4096), (8, 32)])
def test_hot_buckets_lose_no_link(spark, monkeypatch, joined, block):
    """Clusters of near copies that fill buckets, joined and in blocks, against all pairs."""
    monkeypatch.setattr(simhash, "JOINED", joined)
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(5)
    bits = sorted(cluster(rng, 150, 7) | cluster(rng, 60, 3) | {int(x) for x in rng.integers(1 << 62, size=40)})
    frame = spark.createDataFrame([(i, b) for i, b in enumerate(bits)], "_id bigint, w0 bigint")
    got = {r["_id"]: r["component_id"] for r in simhash.classes(frame, 4, lambda n: simhash.cut("w0", 4, n)).collect()}
    label = list(range(len(bits)))
    for _ in range(len(bits)):
        new = [min(label[j] for j in range(len(bits)) if (bits[i] ^ bits[j]).bit_count() <= 4) for i in range(len(bits))]
        if new == label:
            break
        label = new
    assert got == dict(enumerate(label))


def test_segments_cover_the_radius():
    for radius in (1, 2, 4, 7):
        for rows in (10, 1 << 30):
            parts = simhash.cut("w0", radius, rows)
            assert sum(own + 1 for *_, own in parts) == radius + 1
            assert sum(width for _, _, width, _ in parts) == 64


def test_similar_texts_meet(spark):
    """Copies with one word in fifty changed are one class; other texts stay apart."""
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(5_000)]
    rows, truth = [], {}
    for group in range(20):
        text = list(rng.choice(words, 400))
        for copy in range(3):
            own = list(text)
            for at in rng.choice(400, 6 * (copy > 0), replace=False):
                own[at] = "changed" + str(at)
            rows.append((10 * group + copy, " ".join(own)))
            truth[10 * group + copy] = 10 * group
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert sum(got[i] == truth[i] for i in truth) >= 58
    assert all(got[i] // 10 == i // 10 for i in truth)


def test_what_an_explode_makes_is_not_broadcast(spark):
    """Spark takes the probes, some seventy rows of each fingerprint, to be as small as the fingerprints."""
    prints = spark.range(1000).select(F.col("id").alias("node"), F.xxhash64("id").alias("w0"))
    found = simhash.links(prints, 4, simhash.cut("w0", 4, 1000))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and not re.search("BroadcastHashJoin .*Inner", plan)
