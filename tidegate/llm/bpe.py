"""Byte-level BPE over many texts at once.

The tokenizers library spends most of its time on cutting texts into pre-tokens and on encoding the same pre-tokens
again. Here NumPy cuts a block of texts into pre-tokens, each distinct one is encoded once by the library's own model,
and the ids are gathered by index. The ids equal those of Tokenizer.encode(text, add_special_tokens=False): where a text
holds the string of one of the vocabulary's added tokens, that is cut out first and has the token's own id. Tests compare
the two.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
# The code points of Unicode's White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Code points a block of texts has at most, unless one text is longer and has no place to cut.
BLOCK = 1 << 21
_SAFE = re.compile(r"(?<=[^\W_]) (?=[^\W_])")


def assigned() -> Iterator[int]:
    """Code points that can be letters, numbers, marks or signs; all others are unassigned or for private use."""
    yield from range(0x40000)
    yield from range(0xE0000, 0xE1000)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and random hash value of every code point."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    for c in assigned():
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            kinds[c] = LETTER
        elif k == "N":
            kinds[c] = NUMBER
    kinds[WHITE_SPACE] = SPACE
    values = np.random.default_rng(20240229).integers(1, 1 << 63, 0x110000, dtype=np.uint64)
    return kinds, values


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def starts(points: np.ndarray, doc_starts: np.ndarray, added: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin. doc_starts: where texts begin; no pre-token crosses these. added: begin and end of each
    added token, which is a pre-token of its own, between what count as texts of their own."""
    n = len(points)
    kind = _tables()[0][points]
    fresh = np.zeros(n, bool)
    fresh[doc_starts[doc_starts < n]] = True
    fresh[added[added < n]] = True
    begins = fresh.copy()
    begins[1:] |= kind[1:] != kind[:-1]
    # The last blank before a word stands apart from those before it, and a plain one belongs to the word.
    words = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~fresh[1:]) + 1
    begins[words - 1] = True
    begins[words[points[words - 1] == 32]] = False
    # English contractions, where an apostrophe begins a pre-token.
    marks = np.flatnonzero((points == 39) & begins)
    marks = marks[marks + 1 < n]
    marks = marks[~fresh[marks + 1]]
    if len(marks):
        one = points[marks + 1]
        two = np.where(marks + 2 < n, points[np.minimum(marks + 2, n - 1)], 0)
        two = np.where((marks + 2 < n) & ~fresh[np.minimum(marks + 2, n - 1)], two, 0)
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 2, 0)
        for a, b in ("re", "ve", "ll"):
            size = np.where((one == ord(a)) & (two == ord(b)), 3, size)
        marks, size = marks[size > 0], size[size > 0]
        begins[marks + 1] = False
        ends = marks + size
        begins[ends[ends < n]] = True
    for a, b in added.tolist():
        begins[a + 1 : b] = False
    return np.flatnonzero(begins)


class Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as far as asked for."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = pow(self.BASE, -1, 1 << 64)
            up, down = np.full(n, self.BASE, np.uint64), np.full(n, inverse, np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up, self.down


def span_hashes(points: np.ndarray, begins: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """64-bit hashes of spans: random values of the code points, weighted by place in the span."""
    up, down = powers.get(len(points) + 1)
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(_tables()[1][points] * up[: len(points)], out=total[1:])
    found = (total[ends] - total[begins]) * down[begins]
    found ^= (ends - begins).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    found ^= found >> np.uint64(29)
    return found * np.uint64(0xBF58476D1CE4E5B9)


def _byte_letters() -> dict[int, int]:
    """The printable stand-in of each byte in the vocabulary file: itself if printable, else the next from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + k for k, b in enumerate(rest)}


class ByteBpe:
    """Encoder with a bounded memory of pre-tokens; one for each Python worker and vocabulary file."""

    def __init__(self, path: str, remembered: int = 3_000_000) -> None:
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        self.model = whole.model
        found = whole.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word or any(c.isspace() for c in t.content) for t in found.values()):
            raise ValueError(f"{path}: added tokens with blanks, or that take in what is beside them, aren't supported")
        #: Ids of the strings of added tokens, and the pattern that finds them, longer ones first.
        self.added = {t.content: i for i, t in found.items()}
        self.pattern = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.letters = _byte_letters()
        self.remembered = remembered
        self.powers = Powers()
        self.forget()

    def forget(self) -> None:
        #: Hashes in order, the slot of each, and where the ids of each slot begin (some 40 bytes for each pre-token).
        self.known, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.first, self.ids = array("I", [0]), array("H")

    def added_spans(self, text: str, doc_starts: np.ndarray) -> np.ndarray:
        """Begin and end of each added token; none crosses the beginning of a text."""
        if not any(a in text for a in self.added):
            return np.zeros((0, 2), np.int64)
        bounds = np.append(doc_starts, len(text)).tolist()
        found = [m.span() for a, b in zip(bounds, bounds[1:]) for m in self.pattern.finditer(text, a, b)]
        return np.array(found, np.int64).reshape(-1, 2)

    def encode_word(self, word: str) -> list[int]:
        return [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]

    def words(self, text: str, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the pre-tokens of a text (or of texts put together) and the slot of each."""
        points = code_points(text)
        added = self.added_spans(text, doc_starts)
        begins = starts(points, doc_starts, added)
        if not len(begins):
            return begins, begins
        ends = np.append(begins[1:], len(points))
        hashes = span_hashes(points, begins, ends, self.powers)
        whole = np.zeros(len(begins), bool)
        if len(added):
            whole[np.searchsorted(begins, added[:, 0])] = True
        hashes[whole] = ~hashes[whole]  # the same characters as plain text are another pre-token
        distinct, at, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > self.remembered:
            self.forget()
        near = np.searchsorted(self.known, distinct)
        held = near < len(self.known)
        held[held] = self.known[near[held]] == distinct[held]
        slots = np.empty(len(distinct), np.int32)
        slots[held] = self.slot[near[held]]
        new = np.flatnonzero(~held)
        slots[new] = np.arange(len(new)) + len(self.first) - 1
        encode, ids, first = self.encode_word, self.ids, self.first
        for i, j, own in zip(begins[at[new]].tolist(), ends[at[new]].tolist(), whole[at[new]].tolist()):
            ids.extend([self.added[text[i:j]]] if own else encode(text[i:j]))
            first.append(len(ids))
        self.known = np.insert(self.known, near[new], distinct[new])
        self.slot = np.insert(self.slot, near[new], slots[new])
        return begins, slots[back]

    def sizes(self, slots: np.ndarray) -> np.ndarray:
        """Ids of each pre-token."""
        first = np.frombuffer(self.first, np.uint32)
        return (first[slots + 1] - first[slots]).astype(np.int64)

    def gather(self, slots: np.ndarray) -> np.ndarray:
        """All ids of pre-tokens, put together."""
        if not len(slots):
            return np.zeros(0, np.uint16)
        size, first = self.sizes(slots), np.frombuffer(self.first, np.uint32)[slots].astype(np.int64)
        total = np.cumsum(size)
        return np.frombuffer(self.ids, np.uint16)[np.repeat(first - (total - size), size) + np.arange(total[-1])]

    def encode_block(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        doc_starts = np.cumsum(lengths) - lengths
        begins, slots = self.words("".join(texts), doc_starts)
        ids, size = self.gather(slots), self.sizes(slots)
        total = np.append(0, np.cumsum(size))
        at = total[np.searchsorted(begins, np.append(doc_starts, lengths.sum()))]
        return [ids[a:b] for a, b in zip(at[:-1], at[1:])]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, in blocks of bounded size; a very long text is cut before a blank between two words."""
        out: list[np.ndarray] = []
        block: list[str] = []
        size = 0
        for text in texts:
            if block and size + len(text) > BLOCK:
                out += self.encode_block(block)
                block, size = [], 0
            if len(text) > BLOCK:
                out.append(np.concatenate([self.encode_block([p])[0] for p in long_parts(text, BLOCK)]))
            else:
                block.append(text)
                size += len(text)
        return out + (self.encode_block(block) if block else [])


def long_parts(text: str, size: int) -> list[str]:
    """Parts of a text that have the pre-tokens of the whole: a blank between two letters or digits begins one."""
    parts, at = [], 0
    while len(text) - at > size:
        found = _SAFE.search(text, at + size)
        if not found:
            break
        parts.append(text[at : found.start()])
        at = found.start()
    return [*parts, text[at:]]


_ENCODERS: dict[str, ByteBpe] = {}


def encoder(path: str) -> ByteBpe:
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteBpe(path)
    return _ENCODERS[path]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
