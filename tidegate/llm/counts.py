"""Edit-aware token counts.

Each document keeps a segment tree over its pre-tokens. A leaf holds some pre-tokens in a row, with their characters and
ids; an inner node holds the sums below it. An edit finds the leaves that it touches by descent, widens to the nearest
places on both sides where the pre-tokens before and after can't depend on each other (a blank between two words, untouched
by the edit), encodes that region alone, and updates the sums above the changed leaves. The count is the root's.

A leaf has at most a bound of pre-tokens that grows with the square root of the text; where an edit outgrows it, the tree is
dealt out anew. So an edit copies and encodes a few leaves, never the text.

Defined results: a null or empty text has no ids, and can be edited; edits are clipped to the text; repeated rows are
counted each; null ids are kept; other columns are ignored; an empty table gives an empty result; a string of an added
token of the vocabulary counts as that token, as in the library.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.bpe import encoder
from tidegate.llm.common import chunks, slices

_BLOCK = 1 << 20
_REMEMBERED = 200_000
#: Pre-tokens of a leaf when the tree is dealt out; it may grow to twice as many.
LEAF = 32
_SIZES: dict[str, dict[str, int]] = {}


def region_sizes(text: str, vocabulary: str, pattern) -> tuple[list[int], list[int]]:
    """Characters and ids of the pre-tokens of a short text."""
    e = encoder(vocabulary)
    held = _SIZES.setdefault(vocabulary, {})
    if len(held) > _REMEMBERED:
        held.clear()
    chars, sizes, at = [], [], 0
    for a, b in [*e.added_spans(text, np.zeros(1, np.int64)).tolist(), (len(text), len(text))]:
        for w in pattern.findall(text[at:a]):
            n = held.get(w)
            if n is None:
                n = held[w] = len(e.encode_word(w))
            chars.append(len(w))
            sizes.append(n)
        if b > a:
            chars.append(b - a)
            sizes.append(1)
        at = b
    return chars, sizes


class CountTree:
    """chars and ids: of each pre-token of the text."""

    def __init__(self, text: str, chars: list[int], ids: list[int], vocabulary: str, pattern) -> None:
        self.vocabulary, self.pattern, self.encoded = vocabulary, pattern, 0
        self._deal(text, chars, ids)

    def _deal(self, text: str, chars: list[int], ids: list[int]) -> None:
        each = max(LEAF, isqrt(len(chars)))
        self.bound = 2 * each
        cuts = range(0, max(len(chars), 1), each)
        self.leaves = 1 << (len(cuts) - 1).bit_length()
        #: Of each leaf: its text, and the characters and ids of its pre-tokens.
        self.parts: list[tuple[str, list[int], list[int]]] = []
        at = 0
        for k in cuts:
            own = chars[k : k + each]
            size = sum(own)
            self.parts.append((text[at : at + size], own, ids[k : k + each]))
            at += size
        self.parts += [("", [], [])] * (self.leaves - len(cuts))
        #: Node 1 is the root, node n has the children 2n and 2n + 1: sums of characters, ids and pre-tokens.
        self.tree = [(0, 0, 0)] * self.leaves + [(len(t), sum(i), len(c)) for t, c, i in self.parts]
        for n in range(self.leaves - 1, 0, -1):
            self._sum(n)

    def _sum(self, n: int) -> None:
        a, b = self.tree[2 * n], self.tree[2 * n + 1]
        self.tree[n] = a[0] + b[0], a[1] + b[1], a[2] + b[2]

    @property
    def total(self) -> int:
        return self.tree[1][1]

    @property
    def length(self) -> int:
        return self.tree[1][0]

    @property
    def pretokens(self) -> int:
        return self.tree[1][2]

    @property
    def text(self) -> str:
        return "".join(p[0] for p in self.parts)

    def leaf(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character (the last one with any, for the text's end), and where it begins."""
        node, at = 1, 0
        while node < self.leaves:
            node *= 2
            left = self.tree[node][0]
            if place - at >= left and self.tree[node + 1][0] > 0:
                at += left
                node += 1
        return node - self.leaves, at

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces text[start:end]."""
        size = self.length
        start = min(max(start, 0), size)
        end = min(max(end, start), size)
        first, base = self.leaf(max(start - 2, 0))
        last, _ = self.leaf(end)
        step = 1
        while True:
            own = self.parts[first : last + 1]
            text = "".join(p[0] for p in own)
            chars, ids = [c for p in own for c in p[1]], [i for p in own for i in p[2]]
            bounds = [0, *accumulate(chars)]
            # Whether pre-tokens before and from a bound on don't depend on each other.
            apart = lambda p: 0 < p < len(text) - 1 and text[p] == " " and text[p + 1].isalpha() and not text[p - 1].isspace()
            lo = next((k for k in range(len(bounds) - 1, -1, -1) if bounds[k] + 2 <= start - base and apart(bounds[k])), None)
            hi = next((k for k, p in enumerate(bounds) if p > end - base and apart(p)), None)
            left, right = lo is None and base > 0, hi is None and base + len(text) < size
            if not left and not right:
                break
            if left:
                more = max(first - step, 0)
                base -= sum(len(p[0]) for p in self.parts[more:first])
                first = more
            if right:
                last = min(last + step, self.leaves - 1)
            step *= 2
        lo, hi = 0 if lo is None else lo, len(chars) if hi is None else hi
        region = text[bounds[lo] : start - base] + new + text[end - base : bounds[hi]]
        made_chars, made_ids = region_sizes(region, self.vocabulary, self.pattern)
        self.encoded += len(made_chars)
        text = text[: bounds[lo]] + region + text[bounds[hi] :]
        chars[lo:hi], ids[lo:hi] = made_chars, made_ids
        room = last - first + 1
        each = -(-len(chars) // room)
        if each > self.bound:
            before, after = self.parts[:first], self.parts[last + 1 :]
            text = "".join([*(p[0] for p in before), text, *(p[0] for p in after)])
            self._deal(text, *([x for p in before for x in p[c]] + mid + [x for p in after for x in p[c]] for c, mid in ((1, chars), (2, ids))))
            return
        at = 0
        for k in range(room):
            own_chars, own_ids = chars[k * each : (k + 1) * each], ids[k * each : (k + 1) * each]
            n = sum(own_chars)
            self.parts[first + k] = text[at : at + n], own_chars, own_ids
            self.tree[self.leaves + first + k] = n, sum(own_ids), len(own_chars)
            at += n
        lo, hi = (self.leaves + first) // 2, (self.leaves + last) // 2
        while lo:
            for n in range(lo, hi + 1):
                self._sum(n)
            lo, hi = lo // 2, hi // 2


def trees(texts: list[str], vocabulary: str, pattern) -> Iterator[CountTree]:
    e = encoder(vocabulary)
    for i, j in chunks(texts, _BLOCK):
        lengths = np.fromiter(map(len, texts[i:j]), np.int64, j - i)
        starts = np.append(0, np.cumsum(lengths))
        begins, slots = e.words("".join(texts[i:j]), starts[:-1])
        sizes = e.sizes(slots).tolist() if len(slots) else []
        chars = np.diff(np.append(begins, starts[-1])).tolist()
        first = np.searchsorted(begins, starts)
        for k in range(j - i):
            own = slice(first[k], first[k + 1])
            yield CountTree(texts[i + k], chars[own], sizes[own], vocabulary, pattern)


def sample_edits(text: str) -> list[tuple[int, int, str]]:
    """Four edits that a text's own checksum places: a replaced word, an insertion, a deletion and an appended line."""
    n, mark = len(text), zlib.crc32(text.encode("utf-8", "surrogatepass"))
    p = mark % (n + 1)
    q = (mark // 7) % (n + 1)
    r = (mark // 131) % (n + 1)
    return [(p, p + 6, "revised"), (q, q, f" note {mark % 1000}, it's"), (r, r + 40, ""), (n, n, "\nlast line.")]


def edited_counts(docs: DataFrame, vocabulary: str, pattern: str, edits=sample_edits, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_pretokens, n_tokens, n_edits, n_reencoded (pre-tokens), n_tokens_after, n_chars_after."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        compiled = regex.compile(pattern)
        for b in slices(batches):
            out = []
            texts = [t or "" for t in b.column(1).to_pylist()]
            for text, t in zip(texts, trees(texts, vocabulary, compiled)):
                before, held = t.total, t.pretokens
                made = edits(text)
                for e in made:
                    t.edit(*e)
                out.append((held, before, len(made), t.encoded, t.total, t.length))
            names = ["n_pretokens", "n_tokens", "n_edits", "n_reencoded", "n_tokens_after", "n_chars_after"]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * len(names)))], names=["doc_id", *names])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_pretokens long, n_tokens long, n_edits long, n_reencoded long, n_tokens_after long, n_chars_after long")
