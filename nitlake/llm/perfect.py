"""Minimal perfect hashing of 128-bit keys in NumPy: level by level, keys that are alone at their bit stay there.

A level has about twice as many bits as keys are left. A key's slot is the number of set bits before
its own, so the slots of n keys are 0 to n - 1 and whatever belongs to a key lies in arrays without
gaps. The structure takes about four bits a key and says nothing of other keys: these may get a slot
too, and a fingerprint beside the slot tells them apart.
"""

from __future__ import annotations

import numpy as np

from .words import mixed

#: Bits of a level for each key that is left.
ROOM = 2.0


def _place(one: np.ndarray, two: np.ndarray, level: int, size: int) -> np.ndarray:
    found = mixed(one ^ mixed(two + np.uint64(2 * level + 1)))
    return (found % np.uint64(size)).astype(np.int64)


class Perfect:
    """Slots of a fixed set of different keys; a key is two 64-bit unsigned halves."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def build(cls, one: np.ndarray, two: np.ndarray) -> Perfect:
        sizes, words = [], []
        while len(one):
            size = 64 * max(1, int(np.ceil(ROOM * len(one) / 64)))
            at = _place(one, two, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            words.append(np.packbits(alone, bitorder="little").view("<u8").astype(np.uint64))
            crowded = ~alone[at]
            one, two = one[crowded], two[crowded]
        made = np.concatenate(words) if words else np.zeros(0, np.uint64)
        return cls(np.array(sizes, np.int64), made)

    def slots(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The slot of each key; -1, or the slot of another, for keys that were not in the set."""
        out, left = np.full(len(one), -1), np.arange(len(one))
        for level, size in enumerate(self.sizes.tolist()):
            if not len(left):
                break
            at = _place(one[left], two[left], level, size) + self.starts[level]
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            here = (word >> bit) & np.uint64(1) != 0
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[here]] = (self.before[at >> 6] + below)[here]
            left = left[~here]
        return out
