"""Words of many texts at once, as hashes. A word is a run of letters, digits, marks and underscores, in lower case."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np

from tidegate.llm.bpe import Powers, assigned, code_points, span_hashes
from tidegate.llm.common import chunks

#: Code points that are worked on at once; a longer text is worked on alone.
BLOCK = 1 << 20
_POWERS = Powers()


@cache
def fold_table() -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code point of each code point, and whether it belongs to a word."""
    fold, inside = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, bool)
    for c in assigned():
        ch = chr(c)
        if ch.isalnum() or ch == "_" or unicodedata.category(ch)[0] == "M":
            inside[c] = True
            low = ch.lower()
            if len(low) == 1:
                fold[c] = ord(low)
    return fold, inside


class Words:
    """Words of a block of texts: points, begins and ends of words in them, hashes, and the first word of each text."""

    def __init__(self, texts: list[str | None]) -> None:
        texts = [t or "" for t in texts]
        fold, inside = fold_table()
        # A blank between texts ends the word before it.
        self.points = code_points(" ".join(texts))
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.starts = np.append(0, np.cumsum(lengths))
        member = inside[self.points]
        edge = np.diff(member.astype(np.int8), prepend=0, append=0)
        self.begins, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.hashes = span_hashes(fold[self.points], self.begins, self.ends, _POWERS)
        self.first = np.searchsorted(self.begins, self.starts)

    def of(self, k: int) -> np.ndarray:
        return self.hashes[self.first[k] : self.first[k + 1]]

    def places(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the words of text k begin and end in it."""
        own = slice(self.first[k], self.first[k + 1])
        return self.begins[own] - self.starts[k], self.ends[own] - self.starts[k]


def blocks(texts: list[str | None]) -> Iterator[tuple[int, Words]]:
    """Blocks of texts with the place of the first."""
    for i, j in chunks([t or "" for t in texts], BLOCK):
        yield i, Words(texts[i:j])


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n words in a row."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        x = hashes[: len(hashes) - n + 1].copy()
        for k in range(1, n):
            x *= np.uint64(0x9E3779B97F4A7C15)
            x += hashes[k : len(hashes) - n + 1 + k]
        return mix(x)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, n: int = 5) -> np.ndarray:
    """Distinct hashes of n words in a row, ascending; a text of fewer words, but one at least, has a single shingle."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    return np.unique(windows(hashes, min(n, len(hashes))))
