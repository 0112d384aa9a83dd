"""Near duplicates beside all pairs' Jaccard similarity."""

import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from helpers import clashing, odd, odd_rows, rows_of
from nitlake.llm import near
from nitlake.session import FREED, stored

DOC = "doc_id bigint, text string"


def shingles(text, k=5):
    words = [w for w in (text or "").lower().split(" ") if w]
    return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows, least=0.8):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= least:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    smallest = {}
    for (own, _), x in zip(rows, label):
        smallest[x] = min(smallest.get(x, own), own)
    return {own: smallest[x] for (own, _), x in zip(rows, label)}


def changed(rng, text, number, mark):
    out = list(text)
    for at in rng.choice(len(text), number, replace=False):
        out[at] = f"{mark}{at}"
    return out


def test_pairs_by_similarity(spark):
    """At least nine of ten pairs from 0.80 to 0.85 are linked, and none below 0.8."""
    rng, vocabulary = np.random.default_rng(4), [f"w{i}" for i in range(20_000)]
    rows, similarity = [], {}
    for n in range(240):
        text = list(rng.choice(vocabulary, 400))
        other = changed(rng, text, int(rng.integers(5, 16)), "x")
        rows += [(2 * n, " ".join(text)), (2 * n + 1, " ".join(other))]
        similarity[n] = jaccard(shingles(rows[-1][1]), shingles(rows[-2][1]))
    got = {r.doc_id: r.component_id for r in near.similar(spark.createDataFrame(rows, DOC)).collect()}
    linked = {n: got[2 * n + 1] == 2 * n for n in similarity}
    assert not any(linked[n] for n, s in similarity.items() if s < 0.8)
    some = [linked[n] for n, s in similarity.items() if 0.8 <= s <= 0.85]
    assert len(some) > 40 and sum(some) >= 0.9 * len(some)
    assert all(linked[n] for n, s in similarity.items() if s > 0.88)


def test_a_large_group_and_chains(spark):
    """Copies of one text, a chain of changes whose ends differ, and strangers: classes of all pairs."""
    rng, vocabulary = np.random.default_rng(5), [f"w{i}" for i in range(5_000)]
    base = list(rng.choice(vocabulary, 300))
    rows = [(n, " ".join(changed(rng, base, 2, f"c{n}_"))) for n in range(120)]
    link = list(rng.choice(vocabulary, 300))
    for n in range(200, 212):
        rows.append((n, " ".join(link)))
        link = changed(rng, link, 4, f"l{n}_")
    rows += [(n, " ".join(rng.choice(vocabulary, 200))) for n in range(300, 380)]
    rng.shuffle(rows)
    rows = [(int(n), str(t)) for n, t in rows]
    got = {r.doc_id: r.component_id for r in near.similar(spark.createDataFrame(rows, DOC).repartition(3)).collect()}
    assert got == brute(rows)


def test_odd_rows(spark):
    found = rows_of(near.similar(odd(spark)))
    assert len(found) == len(odd_rows()) and found == rows_of(near.similar(clashing(odd(spark))))
    got = dict(found)
    assert got[2] == got[3] == got[4] == 2 and got[9] == got[7] == got[1] == 1 and got[6] == 6
    assert near.similar(odd(spark).limit(0)).collect() == []


@pytest.mark.parametrize("rows", [1, 40_000, 200_000, 10**7])
def test_layout(rows):
    """The promise of the layout: few strangers, and one in twenty pairs at the limit unmet."""
    words, segments, most = near.layout(rows)
    width = segments[0][1]
    assert len(segments) * width <= 64 * words and most < 32 * words
    assert len(segments) * (width + 1) * rows / 2**width <= near.STRANGERS * (64 * words) / (64 * words - 64 + 1) * 1.5
    one = (1 - near.APART) ** width * (1 + width * near.APART / (1 - near.APART))
    assert (1 - one) ** len(segments) <= near.MISSED


def test_all_similar_pairs(spark):
    """Pairs of just the similarity 0.8 are linked, every one, also where frequent passages come first."""
    rng, vocabulary = np.random.default_rng(8), [f"w{i}" for i in range(20_000)]
    common = list(rng.choice(vocabulary, 60))
    rows, similar = [], {}
    for n in range(150):
        text = list(rng.choice(vocabulary, int(rng.integers(20, 300))))
        text = text + common if n % 2 else text
        other = list(text)
        while jaccard(shingles(" ".join(text)), shingles(" ".join(other + ["end"]))) >= 0.8 and len(other) < 2 * len(text):
            other.append(f"t{n}_{len(other)}")
        rows += [(2 * n, " ".join(text)), (2 * n + 1, " ".join(other))]
        similar[n] = jaccard(shingles(rows[-1][1]), shingles(rows[-2][1]))
    assert min(similar.values()) >= 0.8 and np.median(list(similar.values())) < 0.81
    got = {r.doc_id: r.component_id for r in near.similar(spark.createDataFrame(rows, DOC)).collect()}
    assert got == brute(rows)


def test_a_large_group_below_the_similarity_writes_no_pairs(spark, monkeypatch):
    """Texts that meet all others of their group and are none of them similar; blocks smaller than the group."""
    rng, vocabulary, written = np.random.default_rng(9), [f"w{i}" for i in range(5_000)], {}
    base = list(rng.choice(vocabulary, 200))
    rows = [(n, " ".join(changed(rng, base, 7, f"c{n}_"))) for n in range(150)]
    rows += [(1000 + n, rows[n][1] + " end") for n in range(0, 150, 10)]
    keep = near.stored
    monkeypatch.setattr(near, "stored", lambda df, name: written.setdefault(name, keep(df, name)))
    monkeypatch.setattr(near, "discard", lambda *tables: None)
    monkeypatch.setattr(near, "BLOCK", 8_000)
    got = {r.doc_id: r.component_id for r in near.similar(spark.createDataFrame(rows, DOC)).collect()}
    assert got == brute(rows)
    # Every text is filed under some fifty shingles, and is linked once under each at most.
    assert written["gathered"].count() <= 60 * len(rows) and written["alike"].count() <= 60 * len(rows)
    assert written["placed"].agg({"blocks": "max"}).first()[0] > 1


@pytest.mark.parametrize("n", [*range(1, 60), 333, 20_000])
def test_prefixes_of_similar_texts_share_enough(n):
    for other in range(n, 5 * n // 4 + 1):
        both = -(-4 * (n + other) // 9)  # least that is four fifths of the union
        for size in (n, other):
            assert near.prefix(np.array([size]))[0] >= size - both + near.least_shared(n)
            assert near.prefix(np.array([size]))[0] <= size


def test_a_batch_is_printed_in_parts():
    """Four megabytes of text that come at once leave in small batches, with little memory beside them."""
    rng, vocabulary = np.random.default_rng(10), [f"w{i}" for i in range(20_000)]
    texts = [" ".join(rng.choice(vocabulary, 500)) for _ in range(1_400)] + [None, "", " a  b "]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["_id", "_text"])
    assert batch.nbytes > 4_000_000
    single = [next(near._printed(5)(iter([batch.slice(i, 1)]))) for i in range(0, len(texts), 50)]
    tracemalloc.start()
    found, most = [], 0
    for part in near._printed(5)(iter([batch])):
        most = max(most, part.nbytes)
        found.append(part)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 1_500_000 and peak < 10_000_000
    whole = pa.Table.from_batches(found)
    assert whole["_id"].to_pylist() == list(range(len(texts)))
    assert pa.Table.from_batches(single).equals(whole.take(list(range(0, len(texts), 50))))


def test_a_frequent_passage_chains_no_texts_of_other_sizes(spark, monkeypatch):
    """Texts that a passage holds whole, from 30 to 1,500 words: each meets only sizes like its own, and all classes are found."""
    rng, vocabulary, written = np.random.default_rng(11), [f"w{i}" for i in range(5_000)], {}
    passage = list(rng.choice(vocabulary, 1_600))
    rows = []
    for k in range(16):  # lengths of 1.3 apart are not similar; those of a sixth more are
        for n in range(3):
            words = passage[: int(30 * 1.3**k * (1.15 if n == 2 and k % 4 == 0 else 1))]
            rows.append((len(rows), " ".join([*words, f"e{k}_{n}"])))
    keep = near.stored
    monkeypatch.setattr(near, "stored", lambda df, name: written.setdefault(name, keep(df, name)))
    monkeypatch.setattr(near, "discard", lambda *tables: None)
    got = {r.doc_id: r.component_id for r in near.similar(spark.createDataFrame(rows, DOC)).collect()}
    assert got == brute(rows)
    spans = written["placed"].groupBy("root").agg({"n": "max"}).join(written["placed"].groupBy("root").agg({"n": "min"}), "root")
    assert spans.count() > 8 and all(r["max(n)"] <= near.WIDTH**2 * r["min(n)"] + 1 for r in spans.collect())


def test_tables_that_grow_with_the_corpus_are_joined_by_key(spark, monkeypatch):
    """Spark takes a table to be as small as its compressed files, or as what an explode was given."""
    rng, vocabulary, plans = np.random.default_rng(12), [f"w{i}" for i in range(500)], {}
    base = list(rng.choice(vocabulary, 100))
    rows = [(n, " ".join(changed(rng, base, 1, f"c{n}_"))) for n in range(60)]
    keep = near.stored

    def stored(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return keep(df, name)

    monkeypatch.setattr(near, "stored", stored)
    assert {r.component_id for r in near.similar(spark.createDataFrame(rows, DOC)).collect()} == {0}
    assert sum("SortMergeJoin" in plan for plan in plans.values()) > 3
    assert [name for name, plan in plans.items() if re.search("BroadcastHashJoin .*Inner", plan)] == []


def test_strangers_that_are_gathered_are_not_compared_whole(spark, monkeypatch):
    """Texts of one group of which few are similar: prefixes tell the others apart, and only similar texts' sets are dealt."""
    rng, vocabulary, written = np.random.default_rng(13), [f"w{i}" for i in range(20_000)], {}
    passages = [list(rng.choice(vocabulary, 60)) for _ in range(10)]
    rows = [(n, " ".join([*passages[n % 10], *rng.choice(vocabulary, 300)])) for n in range(300)]
    rows += [(1000 + n, rows[n][1] + " end") for n in range(0, 300, 30)]
    keep = near.stored
    monkeypatch.setattr(near, "stored", lambda df, name: written.setdefault(name, keep(df, name)))
    monkeypatch.setattr(near, "discard", lambda *tables: None)
    star = lambda prints: prints.selectExpr("node AS a").crossJoin(prints.selectExpr("min(node) AS b"))
    monkeypatch.setattr(near, "links", lambda prints, *_: star(prints))
    got = {r.doc_id: r.component_id for r in near.similar(spark.createDataFrame(rows, DOC)).collect()}
    assert got == {n: n % 1000 for n, _ in rows}
    assert written["placed"].count() < 60  # of 310


def test_what_a_stored_table_shuffled_is_removed(spark):
    held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: set(re.findall(r"shuffle_\d+_\d+_\d+\.data", held.getAllFiles().toString()))
    old, seen = files(), spark.conf.get(FREED)
    grouped = spark.range(10_000).selectExpr("id % 5000 AS key").groupBy("key").count()
    table = stored(grouped, "grouped")
    until = time.time() + 20
    while files() - old and time.time() < until:
        time.sleep(0.2)
    assert not files() - old and spark.conf.get(FREED) == seen
    assert len(grouped.collect()) == 5000 and files() - old  # what else a caller runs is left alone
    assert table.count() == 5000
