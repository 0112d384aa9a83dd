"""Token ids of whole texts with a public byte-level vocabulary, through the tokenizers library.

The vocabulary's merges never cross a pre-token (a word with the blank before it, a run of digits,
signs or white space), so the ids of a text are those of its pre-tokens in a row, and a worker
encodes each pre-token it meets once. Texts with characters that regular-expression libraries
class differently, and texts that hold an added token of the vocabulary, are encoded whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers

VOCABULARY = "byte_bpe_50k.json"
#: Pre-tokens that a worker remembers before it starts afresh.
REMEMBERED = 1_000_000

# The vocabulary's pre-tokens (public_tokenizers.PATTERN), spelt out for the characters
# that are not sent to the library: there, numbers are digits and the six signs below.
# Letters up to that border are listed, which the expression tests faster than a class it has to work out.
_LETTERS = "".join(c for c in map(chr, range(0x530)) if re.match(r"[^\W\d_²³¹¼½¾]", c))
_PRETOKEN = re.compile(
    rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[\d²³¹¼½¾]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
)
#: Separators and control characters, and anything beyond the scripts below, where libraries differ.
_UNSURE = re.compile("[\x1c-\x1f\x85\xa0\u0300-\u036f\u0530-\U0010ffff]")
#: Common signs beyond that border that all libraries class as neither letter, number nor white space.
_SIGNS = dict.fromkeys(map(ord, "‐‑‒–—―‘’‚“”„†‡•…‰′″‹›€™"))


def _alphabet() -> dict[int, str]:
    """How byte-level vocabularies spell bytes. Printable Latin-1 is itself, the other bytes
    are the characters from 256 on, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Known(dict):
    """Ids of pre-tokens as bytes; the vocabulary's model is asked for those not met before."""

    def __init__(self, model):
        super().__init__()
        self.tokenize, self.spelling = model.tokenize, _alphabet()

    def __missing__(self, part: str) -> bytes:
        spelt = part.encode().decode("latin-1").translate(self.spelling)
        found = np.array([token.id for token in self.tokenize(spelt)], np.uint32).tobytes()
        self[part] = found
        return found


class Encoder:
    """ids(text) of one vocabulary file, as the library gives them with ``add_special_tokens=False``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.split = _PRETOKEN.findall
        self.known = _Known(self.tokenizer.model)
        # A text that holds one of these is cut there first, by the library.
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> np.ndarray:
        unsure = _UNSURE.search(text)
        if unsure and _UNSURE.search(text.translate(_SIGNS)) or any(token in text for token in self.added):
            return np.array(self.whole(text), np.uint32)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        return np.frombuffer(b"".join(map(self.known.__getitem__, self.split(text))), np.uint32)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file; loaded once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def texts(batch, name: str) -> Iterator[str]:
    """The strings of a column, null as empty, one at a time."""
    for value in batch.column(name):
        yield value.as_py() or ""


def default_path() -> str:
    return public_tokenizers.path(VOCABULARY)
