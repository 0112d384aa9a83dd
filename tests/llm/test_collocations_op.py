"""Phrases beside a plain count of every phrase, at every number of shards and every bucket size."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import clashing, odd, rows_of, small
from nitlake.llm import collocations as c

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows, longest=4):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    return f, n


def plain(rows, least, longest=4, share=80, top=2000):
    f, n = plain_counts(rows, longest)
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    dropped = set()
    for (lang, words), a in candidates.items():
        for size in range(2, len(words)):
            for i in range(len(words) - size + 1):
                inner = words[i : i + size]
                if 100 * a >= share * f[lang, inner]:
                    dropped.add((lang, inner))
    best = defaultdict(list)
    for (lang, words), a in candidates.items():
        if (lang, words) not in dropped:
            cuts = []
            for k in range(1, len(words)):
                l, r = f[lang, words[:k]], f[lang, words[k:]]
                cuts.append((2_000_000 * a // (l + r), k, l, r))
            score, _, l, r = min(cuts)
            best[lang].append((-score, -a, " ".join(words).encode(), l, r))
    out = []
    for lang, rows in best.items():
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out, key=repr)


def made(seed=1):
    rng = np.random.default_rng(seed)
    words = ["the", "The", "of", "naïve", "日本", "Über", "rare" , "new", "York", "a"]
    rows = []
    for _ in range(300):
        part = rng.choice(words, rng.integers(0, 40), p=[0.2, 0.05, 0.15, 0.1, 0.05, 0.05, 0.02, 0.18, 0.18, 0.02])
        signs = rng.choice([" ", "  ", "\t", ". ", ",", "\n", "!?"], len(part), p=[0.7, 0.05, 0.05, 0.05, 0.05, 0.05, 0.05])
        rows.append(("".join(w + s for w, s in zip(part, signs)), rng.choice(["en", "de", None], p=[0.6, 0.3, 0.1])))
    rows += [("no end at all " * 40, "fr"), ("x y z w " * 40, "fr"), (None, "en"), ("", None), (" .,\n", "de"), ("one", "xx")]
    return [(t, None if lang is None else str(lang)) for t, lang in rows]


@pytest.mark.parametrize("shards,grain,dealt", [(1, 10**9, 64), (3, 1000, 2)])
def test_beside_plain_counts(spark, monkeypatch, shards, grain, dealt):
    monkeypatch.setattr(c, "DEALT", dealt)
    rows = made()
    docs = spark.createDataFrame(rows, "text string, lang string").coalesce(2)
    f, n = plain_counts(rows)
    least = 5
    found = c.counts(docs, least=least, shards=shards, grain=grain)
    total = {r.lang: r.a for r in found.where("len = 0").collect()}
    assert total == {lang: k for lang, k in n.items() if k}
    got = {}
    for level in c.phrases(found):
        got |= {(r.lang, tuple(r.phrase.split(" "))): (r.a, r.heads, r.tails) for r in level.collect()}
    assert {key: a for key, (a, _, _) in got.items()} == {key: a for key, a in f.items() if a >= least}
    for (lang, words), (_, heads, tails) in got.items():
        assert heads == [f[lang, words[: k + 1]] for k in range(len(words))]
        assert tails == [f[lang, words[len(words) - k - 1 :]] for k in range(len(words))]
    assert rows_of(c.ranked(found)) == plain(rows, least)


def test_a_full_map_changes_nothing(spark, monkeypatch):
    """With a map of 64 bits every phrase seems to be made of frequent parts."""
    marked = c._marked
    monkeypatch.setattr(c, "_marked", lambda keys, bits: marked(keys, 6))
    monkeypatch.setattr(c, "DEALT", 3)
    monkeypatch.setattr(c.np, "clip", lambda x, *_: 6)
    rows = made(2)
    docs = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    got = rows_of(c.collocations(docs, least=6, longest=3, share=50, top=7))
    assert got == plain(rows, 6, 3, 50, 7)


def test_table_and_other_columns(spark):
    docs = small(spark)
    rows = [(r.text, r.lang) for r in docs.select("text", "lang").collect()]
    assert rows_of(c.collocations(docs, least=10, shards=2)) == plain(rows, 10)
    lone = [(r.text, r.lang) for r in odd(spark).collect()]
    assert rows_of(c.collocations(clashing(odd(spark)), least=2, shards=1)) == plain(lone, 2)
    assert c.collocations(odd(spark).limit(0)).collect() == []
    with pytest.raises(ValueError):
        c.counts(docs, longest=5)
