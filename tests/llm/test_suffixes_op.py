import hashlib

import pytest
from helpers import LONG, PLAIN, SMALL, clashing, odd, odd_rows, rows_of, small
from nitlake.llm import queries, suffixes, words


def brute(rows, length=100):
    """By the definition; rows that repeat an id and text are one document, null ids come first."""
    seen, out = {}, []
    digest = lambda text: hashlib.sha256((text or "").encode()).hexdigest()
    order = lambda r: (r[0] is not None, r[0] or 0, digest(r[1]))
    number = {place: i for i, place in enumerate(sorted({order(r) for r in rows}))}
    for row in sorted(rows, key=order):
        own, text = row
        data, one = (text or "").encode(), number[order(row)]
        covered = bytearray(len(data))
        for at in range(len(data) - length + 1):
            first = seen.setdefault(data[at : at + length], (one, at))
            if first != (one, at):
                covered[at : at + length] = b"\1" * length
        kept = bytes(b for b, c in zip(data, covered, strict=True) if not c)
        spans = sum(1 for run in bytes(covered).split(b"\0") if run)
        out.append((own, len(data), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in small(spark).collect()]
    assert rows_of(queries.QUERIES["op10_suffix_dedup"](spark, SMALL)) == brute(rows)


@pytest.mark.parametrize(("hot", "block", "batches"), [(1, 2_000_000, 4), (20_000, 3_000, 3), (2, 5_000, 1)])
def test_spread_keys_pieces_and_levels(spark, monkeypatch, hot, block, batches):
    """Every key spread, long texts in pieces, and other numbers of levels change nothing."""
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "BLOCK", block)
    monkeypatch.setattr(words, "BLOCK", block)
    monkeypatch.setattr(suffixes, "BATCHES", batches)
    line = "Licensed to whom it may concern under the terms that everybody knows and nobody reads, " + "x" * 30
    rows = [(i, f"{i} {PLAIN * (i % 3)} number {i * i} {line} {i}" + PLAIN[: 20 * i]) for i in range(12)]
    rows += [(90, LONG[:40_000]), (91, "b" * 700), (92, LONG[3_000:30_000] + "b" * 150), (93, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert rows_of(suffixes.removal_digests(docs)) == brute(rows)


def test_odd_rows(spark):
    rows = [(i, t) for i, t, *_ in odd_rows()]
    docs = odd(spark)
    for some, want in ((docs, brute(rows)), (docs.where("doc_id IS NOT NULL"), brute([r for r in rows if r[0] is not None]))):
        assert rows_of(suffixes.removal_digests(some)) == want
    assert rows_of(suffixes.removal_digests(clashing(docs))) == brute(rows)
    assert rows_of(suffixes.removal_digests(docs.limit(0))) == []


def test_ids_that_repeat_or_are_null(spark):
    """Every text is cut by its own places; ids with several texts, a third of the rows without one."""
    tail = " and a tail of its own that nobody else has, long enough to hold a hundred bytes by itself, surely."
    unique = "".join(f"{i * 7919 % 10007} " for i in range(90))
    rows = [(1, PLAIN * 2), (7, PLAIN * 2 + tail), (7, unique), (7, unique), (7, PLAIN), (9, None), (9, ""), (9, unique[50:])]
    rows += [(None, PLAIN + str(i) + tail * (i % 3)) for i in range(4)] + [(None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = rows_of(suffixes.removal_digests(docs))
    assert found == brute(rows)
    whole = [r for r in found if r[0] == 7 and r[1] == len(unique)]
    assert len(whole) == 2 and all(r[2] == 0 for r in whole)
    kept = suffixes.without_repeats(clashing(docs))
    assert kept.count() == len(rows) and kept.where("doc_id = 7").where(f"text = '{unique}'").count() == 2


def test_texts_without_repeats_keep_columns_and_characters(spark):
    passage = "é" * 70
    docs = clashing(spark.createDataFrame([(1, "a" + passage), (2, passage + "ü"), (3, None)], "doc_id bigint, text string"))
    made = suffixes.without_repeats(docs)
    assert made.columns == docs.columns
    # The passage repeats itself from its second character on, so the first text loses by it too.
    assert {r.doc_id: r.text for r in made.collect()} == {1: "aé", 2: "ü", 3: None}
