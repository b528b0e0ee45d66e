"""Vector best-fit packing of documents into sequences.

A piece demands three capacities of a sequence: its tokens, one document, and its attention cost (its length squared). By
decreasing length, a piece goes to the open sequence with the least weighted residual norm, or with the greatest weighted
dot product of demand and residual, among those with room in all three; a new sequence opens only if there is none.

A piece's demand depends on its length alone, so the plan needs no more than the number of pieces of each length (at most
as many counts as a sequence has tokens). Sequences that look alike are planned together, which keeps the plan at some
thousand entries whatever the input's size. With rule "norm" this places pieces as one-by-one placing would; with rule
"dot" ties within a group of like sequences are taken in another order, so the number of sequences can differ by a few. At
the default capacities only tokens can bind (every piece has a token, and a sum of squares is at most the square of the
sum); the other two then weigh the score alone. Smaller ones bind, as in tests. The pieces themselves stay distributed: a piece's rank among those of its length, found from counts per partition, leads to its place in the plan.

Defined results: a null text counts as empty and makes one piece of the separator alone; repeated rows are packed each on
their own; null ids are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm.bpe import encoder
from tidegate.llm.common import cut, slices


@dataclass(frozen=True)
class Capacity:
    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.05, 0.25)
    rule: str = "norm"  # or "dot"


@dataclass
class Plan:
    """Entry k: pieces of length size[k] and rank rank[k] .. rank[k] + count[k] - 1 go, one each, to the sequences from
    sequence[k] on, at offset[k]. Entries are in order of size and rank."""

    size: np.ndarray
    rank: np.ndarray
    count: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int


def plan(counts: dict[int, int], cap: Capacity) -> Plan:
    """counts: pieces of each length."""
    full = np.array([cap.tokens, cap.documents, cap.attention], np.float64)
    w = np.array(cap.weights)
    left = np.zeros((1024, 3))  # what each group of like sequences has left
    many = np.zeros(1024, np.int64)
    base = np.zeros(1024, np.int64)
    groups, sequences = 0, 0
    entries: list[tuple[int, int, int, int, int]] = []

    def add(residual: np.ndarray, n: int, at: int) -> None:
        nonlocal left, many, base, groups
        if not n or residual[0] < 1 or residual[1] < 1 or residual[2] < 1:
            return  # a full sequence takes nothing more
        if groups == len(many):
            left, many, base = np.vstack([left, np.zeros_like(left)]), np.append(many, np.zeros_like(many)), np.append(base, np.zeros_like(base))
        left[groups], many[groups], base[groups] = residual, n, at
        groups += 1

    for size in sorted(counts, reverse=True):
        need = np.array([size, 1, size * size], np.float64)
        if (need > full).any():
            raise ValueError(f"a piece of {size} tokens fits no sequence")
        rest, rank = counts[size], 0
        while rest:
            fits = np.flatnonzero((many[:groups] > 0) & (left[:groups] >= need).all(axis=1))
            if not len(fits):
                # No open sequence has room: each new one takes as many pieces of this length as fit, before the next opens.
                per = int(min(full // need))
                for n, each in ((rest // per, per), (1 if rest % per else 0, rest % per)):
                    if n:
                        entries += [(size, rank + j * n, n, sequences, j * size) for j in range(each)]
                        add(full - each * need, n, sequences)
                        rank += n * each
                        sequences += n
                break
            if cap.rule == "dot":
                score = -((left[fits] / full) * (need / full) * w).sum(axis=1)
            else:
                score = (w * ((left[fits] - need) / full) ** 2).sum(axis=1)
            g = fits[np.lexsort((base[fits], score))[0]]
            n = int(min(rest, many[g]))
            entries.append((size, rank, n, int(base[g]), int(cap.tokens - left[g, 0])))
            add(left[g] - need, n, int(base[g]))
            many[g] -= n
            base[g] += n
            rest -= n
            rank += n
        if groups > 512 and (many[:groups] > 0).sum() < groups // 2:
            live = np.flatnonzero(many[:groups] > 0)
            left[: len(live)], many[: len(live)], base[: len(live)] = left[live], many[live], base[live]
            groups = len(live)
    table = np.array(sorted(entries), np.int64).reshape(-1, 5)
    return Plan(*table.T, sequences)


def pieces(docs: DataFrame, vocabulary: str, separator: int, tokens: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and for the ranks pid and nth: the piece's number among those of its length
    in its partition. Only documents of more than `tokens` ids are cut; all pieces but the first are then full."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, seen = TaskContext.get().partitionId(), np.zeros(tokens + 1, np.int64)
        for b in slices(batches):
            out: list[tuple] = []
            for i, got in zip(b.column(0).to_pylist(), encoder(vocabulary).encode([t or "" for t in b.column(1).to_pylist()])):
                ids = np.append(got, separator).astype("<u4")
                first = len(ids) - (len(ids) - 1) // tokens * tokens
                for k, start in enumerate([0, *range(first, len(ids), tokens)]):
                    own = ids[start : first if k == 0 else start + tokens]
                    out.append((i, k, start, len(own), zlib.crc32(own.tobytes()), pid, int(seen[len(own)])))
                    seen[len(own)] += 1
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "pid", "nth"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return cut(rows.mapInArrow(cut_up, "doc_id long, piece int, start long, length long, ids_crc32 long, pid int, nth long"))


def best_fit(docs: DataFrame, vocabulary: str, separator: int = 0, cap: Capacity | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cap = cap or Capacity()
    cut_pieces = pieces(docs, vocabulary, separator, cap.tokens, id_col, text_col)
    held = cut_pieces.groupBy("length", "pid").agg(F.count("*").alias("n"))
    # A few rows for each length and partition; the counts of each length: at most cap.tokens rows.
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.withColumn("before", before)
    counts = {r.length: r.n for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    made = plan(counts, cap)
    place = docs.sparkSession.sparkContext.broadcast(made)  # a bounded number of entries

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = place.value
        key = (p.size << 44) + p.rank
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            k = np.searchsorted(key, (length << 44) + rank, side="right") - 1
            made = [pa.array(p.sequence[k] + rank - p.rank[k]), pa.array(p.offset[k])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*map(b.column, names), *made], names=[*names, "sequence_id", "offset"])

    ranked = cut_pieces.join(held.select("length", "pid", "before"), ["length", "pid"]).withColumn("rank", F.col("before") + F.col("nth"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(placed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
