"""Fill-in-middle beside plain versions over code points."""

import hashlib
import re

import numpy as np
import pytest
from helpers import clashing, odd, odd_rows, rows_of
from hypothesis import given, settings, strategies as st
from nitlake.llm import fim

SPLIT = {"line": r"[^\n]*\n|[^\n]+", "word": r"[^ \t-\r]+[ \t-\r]*|[ \t-\r]+", "character": r"(?s)."}


def plain(id, text, unit="line", rate=100, spm=50, seed=7):
    text = text or ""
    drawn = hashlib.sha256(f"{seed}:{'' if id is None else id}".encode()).hexdigest()
    h = [int(drawn[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = re.findall(SPLIT[unit], text)
    assert "".join(units) == text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(mark in text for mark in fim.SENTINELS) or h[2] % 100 >= rate:
        return id, len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


MORE = [
    (20, "ä\nöü\n\n€uro\U0001f600\nx"), (21, "\n"), (22, "\n\n\n"), (23, "no end"), (24, "a <S> b\nc"), (25, "<S\n<P\n<M\n>"),
    (26, "S>P>M>\n<\n<\n<"), (27, "\r\nmixed\r\n\x85   ends\v\f"), (28, "\U0001f600" * 50), (29, " lead\n tail "),
]


@pytest.mark.parametrize("unit", fim.UNITS)
@pytest.mark.parametrize("rate,spm", [(100, 50), (60, 0), (100, 100), (0, 50)])
def test_beside_a_plain_version(spark, unit, rate, spm):
    texts = [(i, t) for i, t, *_ in odd_rows()] + MORE + [(1000 + k, t) for k in range(40) for _, t in MORE[:1]]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    found = fim.fill_in_middle(docs, unit=unit, rate=rate, spm=spm)
    want = sorted((plain(i, t, unit, rate, spm) for i, t in texts), key=repr)
    assert rows_of(found) == want
    back = found.select("doc_id", fim.restored(found.form, found.output))
    assert rows_of(back) == sorted(((i, t or "") for i, t in texts), key=repr)


def test_blocks_do_not_matter(spark, monkeypatch):
    """Many texts of one block, and a text longer than a block, by the functions themselves."""
    texts = [t for _, t in MORE] * 3
    held = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(held), np.uint8)
    offsets = np.cumsum([0, *map(len, held)])
    for size in (1, 10, 10_000):
        got = []
        for block in fim.blocks(data, offsets, size):
            index = fim.Exceptions(block.data)
            for unit in fim.UNITS:
                units = fim.Units(block, unit, index)
                got.append((unit, block.rows, units.count.tolist(), (units.places(units.count) == block.end).all()))
        for unit, rows, count, whole in got:
            assert whole and count == [len(re.findall(SPLIT[unit], t)) for t in texts[rows]]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aé€\U0001f600\n ", max_size=60))
def test_index_of_exceptions(text):
    index = fim.Exceptions(np.frombuffer(text.encode(), np.uint8))
    points = np.arange(len(text) + 1)
    cuts = np.array([len(text[:k].encode()) for k in points])
    assert (index.to_bytes(points) == cuts).all() and (index.to_points(cuts) == points).all()


def test_other_columns_and_empty_tables(spark):
    docs = odd(spark)
    assert rows_of(fim.digests(clashing(docs))) == rows_of(fim.digests(docs))
    assert fim.digests(docs.limit(0)).collect() == []
    named = docs.selectExpr("concat('x', doc_id) AS name", "text AS body", "doc_id AS _h1")
    want = sorted((plain(None if i is None else f"x{i}", t) for i, t, *_ in odd_rows()), key=repr)
    assert rows_of(fim.fill_in_middle(named, "name", "body")) == want


def test_parameters(spark):
    docs = odd(spark)
    for wrong in ({"unit": "page"}, {"rate": 101}, {"sentinels": ("<P>", "<P>", "<M>")}, {"sentinels": ("aba", "x", "y")},
                  {"sentinels": ("<P>", "><", "y")}):
        with pytest.raises(ValueError):
            fim.fill_in_middle(docs, **wrong)
