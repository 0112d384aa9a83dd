"""Templates, toxicity, URLs, dialogues and licences."""

import re
import zlib

import numpy as np
from check import compare, connect
from helpers import PLAIN, SMALL, clashing, odd, odd_rows, rows_of, small
from nitlake.llm import chat, licences, queries, templates, toxicity, urls

DOC, ITEM = "doc_id bigint, text string", "item_id bigint, text string"


def test_leaks_of_the_table(spark):
    items = {r.item_id: r.text for r in small(spark, "benchmark").collect()}
    texts = {r.doc_id: r.text for r in small(spark).collect()}
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op1_template_leaks"](spark, SMALL).collect()}
    assert {(d, i) for d, t in texts.items() for i, x in items.items() if x in t} == got


QUESTION = "A train leaves the station at 9 and travels 60 km in 3 hours before Anna Smith boards it; how far does it go at 60 km?"


def test_slots(spark):
    other = QUESTION.replace("60", "75").replace("Anna Smith", "Ben").replace("3 hours", "5 hours")
    mixed = QUESTION.replace("60", "75", 1).replace("9", "8")
    rows = [(1, "Before. " + QUESTION + " After."), (2, other.upper().replace("BEN", "Ben")), (3, "x " + other + " y"), (4, mixed), (5, PLAIN)]
    got = {r.doc_id: r for r in templates.leaks(spark.createDataFrame(rows, DOC), spark.createDataFrame([(7, QUESTION)], ITEM)).collect()}
    assert got[1].kind == "copy" and got[1].changed == 0
    assert got[3].kind == "reparameterised" and got[3].changed == 3 and got[3].share == 1
    # One value of the item is two in the document: not the same question with other numbers.
    assert 4 not in got and 5 not in got


def test_names_that_open_sentences(spark):
    """Other names at the start of sentences, also where the item's have two words, and other numbers."""
    item = "Tom has 5 apples. Tom buys 3 more apples. How many apples does Tom have now?"
    other = item.replace("Tom", "Ann").replace("5", "8").replace("3", "6")
    rows = [(1, other), (2, f"Read this. {other} Thanks."), (3, other.replace("Ann", "Ann Lee")), (4, item), (5, item.lower()),
            (6, other.replace("Ann buys", "Bob buys")), (7, PLAIN)]
    got = {r.doc_id: r for r in templates.leaks(spark.createDataFrame(rows, DOC), spark.createDataFrame([(1, item)], ITEM)).collect()}
    assert {1, 2, 3, 4, 5} == set(got)
    assert all(got[i].kind == "reparameterised" for i in (1, 2, 3)) and got[4].kind == "copy"
    assert got[1].share == 1


def test_copies_of_items_with_few_literals(spark):
    """Copies are found whatever their words are; a few windows of a long item are no half of it."""
    numbers = " ".join(f"{i} + {i + 2}" for i in range(10, 40))
    items = {1: "What is 12 + 7 * 3 - 45 / 9?", 2: "Quokka habitat", 3: numbers, 4: f"name the longest river in the whole world. {numbers}"}
    rows = [(i, f"Well, {x} So it is.") for i, x in items.items()]
    rows += [(5, "the longest habitat"), (6, "We name the longest river in the whole world."), (7, "What is 13 + 7 * 3 - 45 / 9?")]
    docs, items = spark.createDataFrame(rows, DOC), spark.createDataFrame(list(items.items()), ITEM)
    got = {(r.doc_id, r.item_id): r.kind for r in templates.leaks(docs, items).collect()}
    assert got == {(1, 1): "copy", (2, 2): "copy", (3, 3): "copy", (4, 3): "copy", (4, 4): "copy"}


def test_short_items_and_odd_rows(spark):
    items = spark.createDataFrame([(1, "name the longest river"), (2, "one"), (3, None), (4, ""), (None, "a b c d e f")], ITEM)
    docs = spark.createDataFrame([(1, "Please NAME the longest river now"), (2, None), (3, ""), (4, "one two")], DOC)
    assert [(r.doc_id, r.item_id) for r in templates.leaks(docs, items).collect()] == [(1, 1)]
    assert templates.leaks(odd(spark), items).collect() == []
    assert templates.leaks(clashing(docs), clashing(items)).count() == 1
    assert templates.leaks(docs.limit(0), items).collect() == templates.leaks(docs, items.limit(0)).collect() == []


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = queries.QUERIES["op8_toxicity"](spark, folder).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    kept = [r for r in got if r.held_out and r.doc_id in labels]
    bad = np.array([r.score for r in kept if labels[r.doc_id]])
    good = np.array([r.score for r in kept if not labels[r.doc_id]])
    assert (bad[:, None] > good).mean() + (bad[:, None] == good).mean() / 2 > 0.8


def test_long_texts_teach(spark):
    """The excerpt holds the worst window; a passage of half a window lies in one whole."""
    word = lambda w: toxicity.Words(next(toxicity.blocks(np.frombuffer(w, np.uint8), np.array([0, len(w)])))).word[0]
    odds = np.zeros(1 << toxicity.WORD_BITS, np.float32)
    odds[word(b"vile")] = 3
    for at in (0, 7_000, 20_000, 39_999):
        words = ["calm"] * 40_000
        words[at] = "vile"
        found = toxicity.excerpt(" ".join(words).encode(), odds)
        assert b"vile" in found and len(found) <= toxicity.EXCERPT and set(found.split()) == {b"calm", b"vile"}
    assert toxicity.excerpt(b"short text", odds) == b"short text"
    assert toxicity.excerpt(b" " * 30_000, odds) == b""
    assert len(toxicity.excerpt(b"x" * 30_000 + b" y", odds)) == toxicity.EXCERPT
    start, size, _ = toxicity.windows(np.zeros(500, int), 1)
    for first in range(500 - 15):
        assert ((start <= first) & (start + size >= first + 16)).any()
    long = "calm words stand here " * 2_000
    docs = spark.createDataFrame([(i, long + ("vile brute " * 20 if i % 2 else "")) for i in range(40)], "doc_id bigint, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, toxic int")
    got = toxicity.toxicity(docs, marks).collect()
    assert len(got) == 40 and all((r.score >= 0.7) == bool(r.doc_id % 2) for r in got)


def test_toxicity_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (6, 0), (7, None), (9, 1), (11, 0), (None, 1)], "doc_id bigint, toxic int")
    got = toxicity.toxicity(odd(spark), labels).collect()
    assert len(got) == len(odd_rows())
    assert all(r.score == 0 for r in got if r.doc_id in (2, 3, 4))
    assert toxicity.toxicity(clashing(odd(spark)), labels).count() == len(got)
    assert toxicity.toxicity(odd(spark), labels.limit(0)).count() == len(got)
    assert toxicity.toxicity(odd(spark).limit(0), labels).collect() == []


def test_gradients():
    """The backward pass against differences of the forward pass."""
    rng = np.random.default_rng(4)
    network = toxicity.Network.fresh(1)
    network.w = {k: v.astype(np.float64) for k, v in network.w.items() if k != "embedding"}
    x = rng.standard_normal((6, 3, toxicity.FEATURES + toxicity.EMBEDDED))
    mask = np.ones((6, 3))
    mask[4:, 1] = 0
    logit, kept = network.forward(x, mask)
    slope = rng.standard_normal(3)
    found, _ = network.gradients(slope, kept)
    for name, grad in found.items():
        for at in list(np.ndindex(network.w[name].shape))[:: max(1, network.w[name].size // 7)]:
            old = network.w[name][at]
            sides = []
            for step in (1e-3, -1e-3):
                network.w[name][at] = old + step
                sides.append(network.forward(x, mask)[0] @ slope)
            network.w[name][at] = old
            assert abs((sides[0] - sides[1]) / 2e-3 - grad[at]) < 2e-3 + 0.02 * abs(grad[at]), name


def test_windows_cover_all_words():
    text = np.repeat([0, 2, 3], [5, 32, 100])
    start, size, of = toxicity.windows(text, 5)
    covered = {int(a) + i for a, n in zip(start, size, strict=True) for i in range(n)}
    assert covered == set(range(137)) and set(of) == {0, 2, 3}
    assert all(text[a] == text[a + n - 1] for a, n in zip(start, size, strict=True))


def judged(url):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = host.translate({i: i + 32 for i in range(65, 91)})
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best and best[2]


def test_urls(spark):
    odd_urls = [None, "", "no scheme", "http://", "HTTPS://WWW.EXAMPLE.ORG/en/12?x#y", "a://b://c.org/", "x://É.Com/de/", "x://fr.com/fr/a://b",
                "http://h.example.org?/es/", "http://example.org/es/\n/x", "http://notexample.org/es/", "http://org", "y" * 50_000]
    rows = [(r.page_id, r.url) for r in small(spark, "pages").collect()]
    pages = spark.createDataFrame(rows + [(10_000 + i, u) for i, u in enumerate(odd_urls)] + [(None, "http://a.org/"), (10_004, odd_urls[4])], "page_id bigint, url string")
    filter = urls.UrlFilter.fit(urls.page_labels(pages, small(spark, "labels")), "url", "label", "page_id")
    for frame in (pages, clashing(pages)):
        got = urls.judged(frame, filter).collect()
        assert len(got) == pages.count()
        text = {i: u for i, u in rows} | {10_000 + i: u for i, u in enumerate(odd_urls)} | {None: "http://a.org/"}
        for r in got:
            host, path, rule, verdict = judged(text[r.page_id])
            assert (r.host, r.path, r.rule) == (host, path, rule)
            assert r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))
    assert urls.judged(pages.limit(0), filter).collect() == []
    none = urls.UrlFilter.fit(pages.selectExpr("page_id", "url", "1 AS label").limit(0), "url", "label", "page_id")
    assert urls.judged(pages, none).count() == pages.count()


def test_every_labelled_suffix_has_its_rate(spark):
    """More labelled URLs than train the trees, and thousands of suffixes: all are counted whole."""
    frame = spark.range(28_000).selectExpr(
        "id AS page_id", "concat('https://www.site', id % 7000, '.com/', id) AS url", "cast(id % 7000 < 1400 AS int) AS label"
    )
    filter = urls.UrlFilter.fit(frame, "url", "label", "page_id")
    got = {r["_suffix"]: (r.suffix_rate, round(np.expm1(r.suffix_seen))) for r in filter.rates.collect()}
    assert len(got) == 7000 and {n for _, n in got.values()} == {4}
    rates = {int(k[8:-4]): rate for k, (rate, _) in got.items()}
    assert all(np.isclose(rate, (4 * (i < 1400) + urls.PRIOR * 0.2) / (4 + urls.PRIOR)) for i, rate in rates.items())


def test_trees_learn(spark):
    """URLs with digits in their host are labelled to block; held-out ones are told apart."""
    rng = np.random.default_rng(6)
    word = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    rows = []
    for i in range(1_200):
        bad = i % 4 == 0
        rows.append((i, f"http://{word(6)}{'%06d' % rng.integers(10**6) if bad else word(6)}.net/{word(3)}/{i % 50}", int(bad)))
    frame = spark.createDataFrame(rows, "page_id bigint, url string, label int")
    filter = urls.UrlFilter.fit(frame.where("page_id < 900"), "url", "label", "page_id")
    got = {r.page_id: r.verdict for r in urls.judged(frame.where("page_id >= 900"), filter).collect()}
    assert sum((v == "block") == (i % 4 == 0) for i, v in got.items()) > 0.95 * len(got)


def test_dialogues(spark):
    shape = "conv_id bigint, turn bigint, role string, text string"
    rows = [(1, 0, "system", "Be kind."), (1, 1, "anna", "Hi"), (1, 2, "ben", None), (1, 3, None, "é!"), (1, 3, None, "é!"), (2, 0, "system", "x"),
            (None, None, "anna", ""), (3, 5, "b", "late"), (3, 4, "a", "early")]
    turns = spark.createDataFrame(rows, shape)
    got = {(r.conv_id, r.participant): r for r in chat.rotate(turns).collect()}
    assert set(got) == {(1, "anna"), (1, "ben"), (1, "unknown"), (None, "anna"), (3, "a"), (3, "b")}
    one = got[1, "unknown"]
    assert one.rendered == (
        "<|system|>\nBe kind.<|end|>\n<|user:anna|>\nHi<|end|>\n<|user:ben|>\n<|end|>\n" + 2 * "<|assistant|>\né!<|end|>\n"
    )
    for row in got.values():
        flags = "".join(f * int(n) for f, n in (run.split(":") for run in row.mask.split(",")))
        assert len(flags) == len(row.rendered) and flags.count("1") == row.trained_chars
        said = "".join(c for c, f in zip(row.rendered, flags, strict=True) if f == "1")
        assert said.count("<|end|>") == row.rendered.count("<|assistant|>")
    assert rows_of(chat.rotate(clashing(turns))) == rows_of(chat.rotate(turns))
    assert chat.rotate(turns.limit(0)).collect() == []


def test_dialogues_and_licences_agree_with_sql(spark):
    con = connect(SMALL)
    for name in ("op7_chat_rotation", "op2_license_scan"):
        count, wrong = compare(queries.QUERIES[name](spark, SMALL), con, queries.ORACLES[name])
        assert count and not wrong


def test_licences(spark):
    mit = next(t for n, t in licences.KNOWN if n == "MIT" and len(t) > 100)
    rows = [
        (1, "Copyright (c) 2020 Somebody\n\n" + mit.upper().replace(",", " ,") + "\n"), (2, "Text.\n  licenced under the Apache Licence, version 2.0!\nMore."),
        (3, "Licensed under the Apache License, Version 2.0. And more."), (4, None), (5, ""), (6, "Licensed under CC BY-NC 4.0."), (6, "Licensed under CC BY-NC 4.0."),
    ]
    docs = spark.createDataFrame(rows, DOC)
    known = licences.known_licences(spark)
    want = [(1, 0, "MIT"), (2, 2, "Apache-2.0"), (6, 0, "CC-BY-NC-4.0"), (6, 0, "CC-BY-NC-4.0")]
    assert rows_of(licences.license_matches(docs, known)) == want
    assert rows_of(licences.license_matches(clashing(docs), known)) == want
    assert licences.license_matches(docs.limit(0), known).collect() == []
    assert licences.license_matches(odd(spark), known).collect() == []
