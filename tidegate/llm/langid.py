"""Language ID by rank-order profiles.

A language's profile is its most frequent letter n-grams (1 to 3 letters, words bounded by a blank) in order of
frequency. A text's own n-grams are ranked alike, and the language with the least out-of-place distance is predicted: the
sum, over the text's n-grams, of how far each lies from its rank in the profile (the profile's size if it is absent).

Profiles are counted over every row that may be learned from, by partial counts for each task and one sum for each
language and n-gram. What reaches the driver is a profile for each language, of a fixed number of n-grams.

Defined results: `und` with score 0 if the text is null, empty or has no letter, or if nothing was learned; a tie goes to
the language that sorts first; null languages aren't learned; other columns are ignored; every row gets a result, repeated
rows too.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm.bpe import assigned
from tidegate.llm.common import chunks, id_crc, slices

PROFILE = 300
LONGEST = 3
UNKNOWN = "und"
_WIDTH = np.uint64(21)
_FLUSH = 200_000


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code point of each letter and mark, 32 for all else; and which are letters."""
    fold, letter = np.full(0x110000, 32, np.uint32), np.zeros(0x110000, bool)
    for c in assigned():
        k = unicodedata.category(chr(c))[0]
        if k in "LM":
            low = chr(c).lower()
            fold[c] = ord(low) if len(low) == 1 else c
            letter[c] = k == "L"
    return fold, letter


def grams(text: str) -> np.ndarray | None:
    """Keys of all n-grams of a text; None if it has no letter."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    fold, letter = _letters()
    if not letter[points].any():
        return None
    x = np.empty(len(points) + 2, np.uint64)
    x[0] = x[-1] = 32
    x[1:-1] = fold[points]
    space = x == 32
    keep = ~(space[1:] & space[:-1])
    x = x[np.append(True, keep)]  # one blank between words
    space = x == 32
    two = (x[:-1] << _WIDTH) | x[1:]
    three = (two[:-1] << _WIDTH) | x[2:]
    return np.concatenate([x[~space], two, three[~space[1:-1]]])


def ranked(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Keys by falling count, then by key; at most `size`. keys: in ascending order."""
    if len(keys) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        near = counts >= least
        keys, counts = keys[near], counts[near]
    return keys[np.argsort(-counts, kind="stable")[:size]]


def counted(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    found = [g for g in (grams(t) for t in texts if t) if g is not None]
    return np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([n for _, n in parts])).astype(np.int64)


def profiles(rows: DataFrame, size: int = PROFILE) -> dict[str, np.ndarray]:
    """rows: text, lang. The profile of each language, counted over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        kept = 0

        def out() -> pa.RecordBatch:
            parts = [(lang, *merged(p)) for lang, p in held.items()]
            lang = np.repeat([p[0] for p in parts], [len(p[1]) for p in parts])
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(np.concatenate([p[1] for p in parts]).astype(np.int64)), pa.array(np.concatenate([p[2] for p in parts]))], names=["lang", "gram", "n"])

        for b in slices(batches):
            texts, langs = b.column(0).to_pylist(), np.array(b.column(1).to_pylist(), object)
            for i, j in chunks([t or "" for t in texts], 1 << 20):
                for lang in set(langs[i:j]):
                    got = counted([texts[k] for k in range(i, j) if langs[k] == lang])
                    if len(got[0]):
                        own = held.setdefault(lang, [])
                        own.append(got)
                        kept += len(got[0])
                if kept > _FLUSH:
                    held = {lang: [merged(p)] for lang, p in held.items()}
                    kept = sum(len(p[0][0]) for p in held.values())
                    if kept > _FLUSH:
                        yield out()
                        held, kept = {}, 0
        if held:
            yield out()

    found = rows.select("text", "lang").where("lang is not null and text is not null").mapInArrow(count, "lang string, gram long, n long")
    found = found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    top = found.withColumn("place", place).where(F.col("place") <= size).collect()  # a fixed number for each language
    out: dict[str, list] = {}
    for r in sorted(top, key=lambda r: (r.lang, r.place)):
        out.setdefault(r.lang, []).append(r.gram)
    return {lang: np.array(v, np.int64).astype(np.uint64) for lang, v in out.items()}


class Judge:
    """Distances of texts to all profiles."""

    def __init__(self, known: dict[str, np.ndarray], size: int = PROFILE) -> None:
        self.langs, self.size = sorted(known), size
        self.keys = np.unique(np.concatenate([known[lang] for lang in self.langs])) if known else np.zeros(0, np.uint64)
        #: Rank of each key in each language; -1 if absent. The last column stands for keys that no language has.
        self.rank = np.full((len(self.langs), len(self.keys) + 1), -1, np.int64)
        for k, lang in enumerate(self.langs):
            self.rank[k, np.searchsorted(self.keys, known[lang])] = np.arange(len(known[lang]))

    def __call__(self, text: str | None) -> tuple[str, float]:
        keys = grams(text) if text else None
        if keys is None or not self.langs:
            return UNKNOWN, 0.0
        own = ranked(*np.unique(keys, return_counts=True), self.size)
        at = np.searchsorted(self.keys, own)
        at[at == len(self.keys)] = 0
        at = np.where(self.keys[at] == own, at, len(self.keys))
        rank = self.rank[:, at]
        far = np.where(rank < 0, self.size, np.abs(rank - np.arange(len(own)))).sum(axis=1)
        best = int(np.argmin(far))
        if len(far) == 1:
            return self.langs[0], 1.0 - far[0] / (self.size * len(own))
        next_best = float(np.partition(far, 1)[1])
        return self.langs[best], float(np.clip((next_best - far[best]) / max(next_best, 1.0), 0.0, 1.0))


def identify(docs: DataFrame, known: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", size: int = PROFILE) -> DataFrame:
    """doc_id, held_out, lang_pred, score (how much nearer the best profile is than the next, as a share)."""
    shared = docs.sparkSession.sparkContext.broadcast(known)  # a fixed number of n-grams for each language

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value, size)
        for b in slices(batches):
            got = [judge(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array([g[0] for g in got], pa.string()), pa.array([float(g[1]) for g in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(id_crc(id_col) % 5 == 0, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(judged, "doc_id long, held_out boolean, lang_pred string, score double")


def learn_and_identify(docs: DataFrame) -> DataFrame:
    """Learns from the rows that are not held out, and predicts all rows."""
    return identify(docs, profiles(docs.where(id_crc("doc_id") % 5 != 0)))
