"""Benchmark decontamination by template canonicalisation.

Words become templates: a number (1,200, 3.5 and twenty-five are one), a unit after or on a number, and a name (a
capitalised word) turn into typed placeholders; other words are kept in lower case. A capitalised word that opens a sentence
may be a name or not, so there are two templates, one with such words as names. Windows of eight template words, over half
of them literal, are hash-joined with the windows of the benchmark's items; an item of fewer words, or one with too few
literal words for windows over half of it, has a window of all its words, LITERAL of them literal at least. What matches
on one diagonal is then checked slot by slot: a value of the item must stand for one and the same value of the document
wherever it comes, and two values for two, so that a question with other numbers and names is caught and a text that
merely has numbers in the same places is not. A pair of document and item is reported if windows that agree cover at least
half of the item's words, or RUN of them in a row.

Benchmark windows are broadcast while they are at most about BLOCK. The windows of a larger benchmark are joined with those
of the documents by a shuffle, on their size and hash; each pair of a document and an item that share one is then checked
with the texts of both, so documents are read once whatever the benchmark's size.

Defined results: null or empty texts and items match nothing, nor do items of fewer than LEAST words; an item that several
rows repeat counts under each of its ids; null ids of documents are kept in the result, rows of the benchmark with a null
id are left out; repeated documents are reported each; other columns are ignored; an empty table on either side gives an
empty result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.bpe import Powers, assigned, span_hashes
from tidegate.llm.common import fresh, slices
from tidegate.llm.words import Words, blocks, fold_table, windows

WINDOW, LEAST, LITERAL, COVERAGE, RUN = 8, 5, 3, 0.5, 13
BLOCK = 2_000_000
NUMBER, UNIT, NAME = 1, 2, 3
# A choice: unit words that count as such after a number, and number words.
UNITS = "kg g mg lb lbs oz km m cm mm mi mile miles meter meters metre metres foot feet inch inches yard yards second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros pound pounds percent degree degrees liter liters litre litres ml l mph kmh watt watts volt volts".split()
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split()
_POWERS = Powers()
_PLACE = np.array([0, 0x1F0D3A5C9B7E2468, 0x2E1C4B7A5D8F1369, 0x3D2B6C8E9FA01472], np.uint64)


@cache
def _kinds() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which code points are digits, which are capitals, and which end a sentence."""
    digit, capital, end = (np.zeros(0x110000, bool) for _ in range(3))
    for c in assigned():
        k = unicodedata.category(chr(c))
        digit[c], capital[c] = k == "Nd", k == "Lu"
    end[[ord(c) for c in ".!?\n\r:;。！？"]] = True
    return digit, capital, end


@cache
def _word_hashes() -> tuple[np.ndarray, np.ndarray]:
    w = Words([" ".join(UNITS), " ".join(NUMBERS)])
    return np.sort(w.of(0)), np.sort(w.of(1))


class Templates:
    """Template words of a block of texts: kind of each word (0: literal), and its hash or its placeholder's; both for
    capitalised words that open sentences as literal words and as names."""

    def __init__(self, w: Words) -> None:
        digit, capital, end = _kinds()
        units, numbers = _word_hashes()
        begins, ends, hashes, word = w.begins, w.ends, w.hashes, np.arange(len(w.begins))
        # A unit on a number (25kg) is a word of its own.
        mixed = np.flatnonzero(digit[w.points[begins]] & ~digit[w.points[ends - 1]])
        if len(mixed):
            others = np.flatnonzero(~digit[w.points])
            at = others[np.searchsorted(others, begins[mixed])]
            points = fold_table()[0][w.points]
            own = span_hashes(points, at, ends[mixed], _POWERS)
            told = np.isin(own, units)
            mixed, at, own = mixed[told], at[told], own[told]
            hashes = hashes.copy()
            hashes[mixed] = span_hashes(points, begins[mixed], at, _POWERS)
            hashes, word = np.insert(hashes, mixed + 1, own), np.insert(word, mixed + 1, mixed)
            begins, ends = np.insert(begins, mixed + 1, at), np.insert(ends, mixed, at)
        n = len(begins)
        starts = np.searchsorted(begins, w.starts)
        head = np.zeros(n, bool)
        head[starts[starts < n]] = True
        head[:1] = True
        first = w.points[begins]
        digits, spoken = digit[first], np.isin(hashes, numbers)
        number = digits | spoken
        after = np.append(False, number[:-1])[:n] & ~head
        unit = after & ~number & np.isin(hashes, units)
        sums = np.append(0, np.cumsum(end[w.points]))
        opens = head.copy()
        opens[1:] |= sums[begins[1:]] > sums[ends[:-1]]
        long = ends - begins > 1
        second = w.points[np.minimum(begins + 1, max(len(w.points) - 1, 0))] if n else first
        name = capital[first] & long & ~capital[second]
        # Parts of one number: 1,200 and 3.5; twenty-five, two hundred, 3 million.
        part = np.zeros(n, bool)
        gap = w.points[ends[:-1]]
        near = (begins[1:] - ends[:-1] == 1) & after[1:]
        part[1:] = near & (digits[1:] & digits[:-1] & np.isin(gap, [44, 46]) | spoken[1:] & np.isin(gap, [32, 45]))
        kept = np.flatnonzero(~part)
        with np.errstate(over="ignore"):
            nth = np.arange(n) - np.maximum.accumulate(np.where(part, 0, np.arange(n)))
            values = np.add.reduceat(hashes * (2 * nth + 1).astype(np.uint64), kept) if n else hashes
        kinds = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name & ~opens, NAME, 0)))[kept]
        self.values, self.word = values, word[kept]
        self.variants = []
        for own in (kinds, np.where((kinds == 0) & name[kept], NAME, kinds)):
            self.variants.append((np.where(own > 0, _PLACE[own], values), own))
        self.first = np.searchsorted(begins[kept], w.starts)
        self.head = w.first

    def of(self, k: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
        """Of text k: templates and kinds, twice or, if there is no difference, once; values; and the words' numbers."""
        own = slice(self.first[k], self.first[k + 1])
        both = [(t[own], kinds[own]) for t, kinds in self.variants]
        return both[: 1 if np.array_equal(both[0][1], both[1][1]) else 2], self.values[own], self.word[own] - self.head[k]


class Benchmark:
    """Items as templates, and their windows in order of hash."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.ids, self.parts, self.spread = [], [], []
        for i, w in blocks([t for _, t in items]):
            found = Templates(w)
            for k in range(len(w.first) - 1):
                part = found.of(k)
                if w.first[k + 1] - w.first[k] >= LEAST:
                    self.ids.append(items[i + k][0])
                    self.parts.append(part)
                    self.spread.append(np.diff(np.append(part[2], w.first[k + 1] - w.first[k])))  # words of each
        rows: dict[int, list[tuple[np.ndarray, np.ndarray, int, int]]] = {}
        for k, (variants, values, _) in enumerate(self.parts):
            for v, (templates, kinds) in enumerate(variants):
                n, size = min(WINDOW, len(values)), len(values)
                at = np.flatnonzero(literal(kinds, n) & (n == WINDOW or (kinds == 0).sum() >= LITERAL))
                rows.setdefault(n, []).append((windows(templates, n)[at], at, k, v))
                covered = np.zeros(size, bool)
                for a in at.tolist():
                    covered[a : a + n] = True
                if covered.mean() < COVERAGE and (kinds == 0).sum() >= LITERAL:
                    rows.setdefault(size, []).append((windows(templates, size), np.zeros(1, np.int64), k, v))
        self.sizes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for n, own in sorted(rows.items()):
            keys, at = np.concatenate([r[0] for r in own]), np.concatenate([r[1] for r in own])
            item, variant = (np.concatenate([np.full(len(r[0]), r[c]) for r in own]) for c in (2, 3))
            order = np.argsort(keys, kind="stable")
            self.sizes[n] = keys[order], item[order], at[order], variant[order]

    def find(self, doc: tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]) -> list[tuple]:
        """(item id, coverage, slots, slots that changed, first word, words) of each item that a document contains."""
        variants, values, words = doc
        hits: dict[tuple[int, int], set[tuple[int, int, int]]] = {}
        for n, (keys, item, at, variant) in self.sizes.items():
            for named, (templates, _) in enumerate(variants):
                own = windows(templates, n)
                if not len(own) or not len(keys):
                    continue
                near = np.searchsorted(keys, own)
                near[near == len(keys)] = 0
                for p in np.flatnonzero(keys[near] == own).tolist():
                    k = int(near[p])
                    while k < len(keys) and keys[k] == own[p]:
                        hits.setdefault((int(item[k]), p - int(at[k])), set()).add((max(named, int(variant[k])), int(variant[k]), int(at[k]), n))
                        k += 1
        best: dict[int, tuple] = {}
        for (k, shift), spans in hits.items():
            both, item_values, _ = self.parts[k]
            for limit in (1, 0):  # openers that contradict each other as names are literal words
                kinds = np.zeros(len(item_values), np.int64)
                covered = np.zeros(len(item_values), bool)
                for named, v, a, n in sorted(spans, reverse=True):  # literal openers last, where they match
                    if named <= limit:
                        covered[a : a + n] = True
                        kinds[a : a + n] = both[v][1][a : a + n]
                slots = np.flatnonzero(covered & (kinds > 0))
                there, back, wrong = {}, {}, 0
                for s in slots.tolist():
                    a, b = (int(kinds[s]), int(item_values[s])), int(values[s + shift])
                    wrong += there.setdefault(a, b) != b or back.setdefault((a[0], b), a) != a
                if covered.any() and wrong * 5 <= len(slots):
                    break
            else:
                continue
            changed = sum(int(item_values[s]) != int(values[s + shift]) for s in slots.tolist())
            known = best.setdefault(k, [np.zeros(len(item_values), bool), 0, 0, 1 << 60])
            known[0] |= covered
            known[1] += len(slots)
            known[2] += changed
            known[3] = min(known[3], int(words[shift + int(np.argmax(covered))]))
        told = [(self.ids[k], np.repeat(c, self.spread[k]), n, changed, first) for k, (c, n, changed, first) in sorted(best.items())]
        return [(i, float(c.mean()), n, changed, first, int(c.sum())) for i, c, n, changed, first in told if c.mean() >= COVERAGE or longest(c) >= RUN]


def longest(covered: np.ndarray) -> int:
    """Length of the longest run."""
    edge = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0, append=0))
    return int((edge[1::2] - edge[::2]).max()) if len(edge) else 0


def literal(kinds: np.ndarray, n: int) -> np.ndarray:
    """Windows that are literal words by more than half."""
    total = np.append(0, np.cumsum(kinds == 0))
    return 2 * (total[n:] - total[:-n]) > n


_SCHEMA = "doc_id long, item_id long, coverage double, n_slots long, n_changed long, first_word long, n_words long"


def _found(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.float64(), *[pa.int64()] * 4)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in _SCHEMA.split(", ")])


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")


def _small(items: DataFrame, block: int) -> Benchmark | None:
    """The benchmark, if it has about `block` windows at most (a word has over four characters, with its blank, or so)."""
    if (items.agg(F.sum(F.length("text"))).first()[0] or 0) > 4 * block:
        return None
    return Benchmark([(r.item_id, r.text) for r in items.orderBy("item_id", "text").collect()])


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        out = []
        for i, m, t in zip(*(c.to_pylist() for c in b.columns)):
            out += [(i, m, n, k) for n, (keys, *_) in Benchmark([(i, t)]).sizes.items() for k in np.unique(keys).astype(np.int64).tolist()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int64()))], names=["item_id", "item_mark", "n", "key"])


def _shuffled(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Matches, and the mark (a hash of the text) of each document, by a join of windows."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text").where("text is not null")
    items = items.select("item_id", F.xxhash64("text").alias("item_mark"), F.col("text").alias("item")).distinct()
    wanted = items.mapInArrow(_item_windows, "item_id long, item_mark long, n int, key long")
    sizes = sorted(r.n for r in wanted.select("n").distinct().collect())  # no more than the longest item has words

    def doc_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 128):
            ids, marks, n_of, keys = [], [], [], []
            docs_, marks_ = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, w in blocks(b.column(2).to_pylist()):
                t = Templates(w)
                for k in range(len(w.first) - 1):
                    variants = t.of(k)[0]
                    for n in sizes:
                        own = np.unique(np.concatenate([windows(x, n) for x, _ in variants])).astype(np.int64)
                        ids += [docs_[i + k]] * len(own)
                        marks += [marks_[i + k]] * len(own)
                        n_of.append(np.full(len(own), n, np.int32))
                        keys.append(own)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(np.concatenate(n_of)), pa.array(np.concatenate(keys))], names=["doc_id", "mark", "n", "key"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, found = None, None
        for b in slices(batches, 128):
            out = []
            for d, m, text, i, item in zip(*(b.column(c).to_pylist() for c in ("doc_id", "mark", "text", "item_id", "item"))):
                if (d, m) != last:
                    last, found = (d, m), Templates(Words([text])).of(0)
                out += [(m, (d, *x)) for x in Benchmark([(i, item)]).find(found)]
            if out:
                own = _found([x for _, x in out])
                yield pa.RecordBatch.from_arrays([pa.array([m for m, _ in out], pa.int64()), *own.columns], names=["mark", *own.schema.names])

    held = rows.select("doc_id", "mark", "text").mapInArrow(doc_windows, "doc_id long, mark long, n int, key long")
    pairs = held.join(wanted, ["n", "key"]).select("doc_id", "mark", "item_id", "item_mark").distinct()
    pairs = pairs.join(items, ["item_id", "item_mark"]).select(F.col("doc_id").alias("id_"), F.col("mark").alias("mark_"), "item_id", "item")
    both = rows.join(pairs, rows["doc_id"].eqNullSafe(pairs["id_"]) & (rows["mark"] == pairs["mark_"])).select("doc_id", "mark", "text", "item_id", "item")
    return both.sortWithinPartitions("doc_id", "mark").mapInArrow(verify, "mark long, " + _SCHEMA)


def contaminated(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per document and item that it contains: doc_id, item_id, coverage (share of the item's words), n_slots and
    n_changed (placeholders in the matching windows, and those with other values), first_word and n_words."""
    items = _items(benchmark)
    small = _small(items, block)
    if small is None:
        return _shuffled(docs, items).drop("mark")
    shared = docs.sparkSession.sparkContext.broadcast(small)  # at most about `block` windows

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids, out = b.column(0).to_pylist(), []
            for i, w in blocks(b.column(1).to_pylist()):
                t = Templates(w)
                for k in range(len(w.first) - 1):
                    out += [(ids[i + k], *m) for m in shared.value.find(t.of(k))]
            if out:
                yield _found(out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(find, _SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of docs that contain no item, with all their columns."""
    items = _items(benchmark)
    small = _small(items, block)
    if small is None:
        own, mark = fresh(docs, "own"), fresh(docs, "mark")
        found = _shuffled(docs, items).select(F.col("doc_id").alias(own), F.col("mark").alias(mark)).distinct()
        same = F.col("doc_id").cast("long").eqNullSafe(F.col(own)) & (F.xxhash64("text") == F.col(mark))
        return docs.join(found, same, "left_anti").select(*docs.columns)
    shared = docs.sparkSession.sparkContext.broadcast(small)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            good: list[bool] = []
            for _, w in blocks(b.column(at).to_pylist()):
                t = Templates(w)
                good += [not shared.value.find(t.of(k)) for k in range(len(w.first) - 1)]
            yield b.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
