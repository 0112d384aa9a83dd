import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from helpers import PLAIN, SMALL, clashing, odd, odd_rows, rows_of, small
from hypothesis import given, settings
from hypothesis import strategies as st
from nitlake.llm import packing, planes, queries, tokens

ENCODER = tokens.Encoder(tokens.default_path())
SAMPLES = "abcXYZ 's't're'll  \n\t\r\x0b\x0c\x1c\x85\xa0\u2003\u3000éñßİı½٣一ñ\u0301 ©—“”€'’0129#*$%&|<>.,_-\u200b\ufeff\U0001f600"


def ids(text, end):
    return np.array([*ENCODER.whole(text or ""), end], np.uint32)


def test_pretokens_give_the_librarys_ids():
    rng = random.Random(1)
    alphabet = [*SAMPLES, "<|endoftext|>", "'s", "'re", " '", "''s", "\n's"]
    for _ in range(3_000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
        assert ENCODER(text).tolist() == ENCODER.whole(text)


def test_added_tokens_are_the_librarys():
    """A tokenizer of its own with its default settings: an added token inside a text is one id."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.default_path())
    for text in ("a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>", "a <|endoftext |> b", PLAIN):
        assert ENCODER(text).tolist() == plain.encode(text, add_special_tokens=False).ids
    assert ENCODER("a <|endoftext|> b").tolist() == [64, 220, 50256, 275]


@settings(max_examples=150, deadline=None)
@given(st.text())
def test_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    assert ENCODER(text).tolist() == ENCODER.whole(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=300))
def test_planes_round_trip(values):
    values = np.array(values, np.uint32)
    assert (planes.unsqueeze(len(values), *planes.squeeze(values)) == values).all()


def test_planes_of_several_blocks():
    values = np.random.default_rng(3).integers(0, 50_257, 2 * planes.BLOCK + 17).astype(np.uint32)
    held = planes.squeeze(values)
    assert len(held[0]) == 3 and (planes.unsqueeze(len(values), *held) == values).all()


def brute_files(rows):
    at, out = 0, []
    for own, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        made = ids(text, 0)
        out.append((own, at, len(made), zlib.crc32(made.tobytes())))
        at += len(made)
    return sorted(out, key=repr)


@pytest.mark.parametrize("segment", [planes.SEGMENT, 500])
def test_files(spark, monkeypatch, segment):
    monkeypatch.setattr(planes, "SEGMENT", segment)
    rows = [(r.doc_id, r.text) for r in small(spark).collect()]
    assert rows_of(queries.QUERIES["op9_bit_planes"](spark, SMALL)) == brute_files(rows)


def test_files_of_odd_rows(spark):
    want = brute_files([(i, t) for i, t, *_ in odd_rows()])
    assert rows_of(planes.file_digests(odd(spark))) == want
    assert rows_of(planes.file_digests(clashing(odd(spark)))) == want
    assert rows_of(planes.file_digests(odd(spark).limit(0))) == []


def checked(got, rows):
    """Every id in one piece, every piece in one gapless sequence."""
    texts, parts, lines = defaultdict(list), defaultdict(list), defaultdict(list)
    for own, text in rows:
        texts[own].append(ids(text, 1))
    for r in got:
        parts[r.doc_id].append(r)
        lines[r.sequence_id].append((r.offset, r.length))
    assert parts.keys() == texts.keys()
    for own, mine in parts.items():
        wanted = sorted(
            (start, min(2048, len(t) - start), zlib.crc32(t[start : start + 2048].tobytes()), len(t))
            for t in texts[own] for start in range(0, len(t), 2048)
        )
        assert sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in mine) == wanted
    for line in lines.values():
        at = 0
        for offset, length in sorted(line):
            assert offset == at
            at += length
        assert at <= 2048
    return lines


def test_packing(spark):
    rows = [(r.doc_id, r.text) for r in small(spark).collect()]
    lines = checked(queries.QUERIES["op4_packing"](spark, SMALL).collect(), rows)
    total = sum(length for line in lines.values() for _, length in line)
    assert len(lines) <= -(-total // 2048) * 1.01 + 1
    checked(packing.packed(small(spark), group=20).collect(), rows)


def test_packing_of_odd_rows(spark):
    rows = [(i, t) for i, t, *_ in odd_rows()]
    checked(packing.packed(odd(spark)).collect(), rows)
    checked(packing.packed(clashing(odd(spark))).collect(), rows)
    assert packing.packed(odd(spark).limit(0)).collect() == []


def test_sequences_hold_the_ids(spark):
    placed = packing.packed(odd(spark).where("doc_id in (1, 6, 8)"), keep=True)
    whole = {r.sequence_id: np.frombuffer(r.ids, np.uint32) for r in packing.sequences(placed, pad=7).collect()}
    texts = {i: ids(t, 1) for i, t, *_ in odd_rows()}
    for r in placed.collect():
        assert (whole[r.sequence_id][r.offset : r.offset + r.length] == texts[r.doc_id][r.start : r.start + r.length]).all()
    for line in whole.values():
        assert len(line) == 2048 or len(line) & (len(line) - 1) == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_tournament_is_first_fit_decreasing(lengths):
    got, _ = packing.first_fit_decreasing(np.array(lengths, np.int64), 50)
    room, want = [], [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at = next((k for k, r in enumerate(room) if r >= lengths[i]), len(room))
        if at == len(room):
            room.append(50)
        room[at] -= lengths[i]
        want[i] = at
    assert got.tolist() == want
