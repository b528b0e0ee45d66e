"""Toxicity by class-conditional Kneser-Ney models.

Two models of words, one of toxic and one of ordinary texts. A word's probability in a class is its discounted continuation
count there (after how many different words it comes, which copies of a text don't raise), interpolated with the
continuation counts that both classes share. How much mass goes to the shared counts is the same for both classes, so an
expression that is too rare to tell the classes apart has the same probability in both: n-grams seen in DISCOUNT contexts or
fewer speak through the shared backoff alone.

The difference of the two log-likelihoods is normalised by length, over the whole text and over each passage of PASSAGE
words (a shorter text counts as one passage). A text's score is a logistic curve of both: of its whole, and of its most
toxic passage, since a mean over a long text hides the few expressions that make it toxic. The curve is fitted by
cross-fitting: rows are dealt to FOLDS folds by a hash of their texts, and each is judged by models of all other folds.

All labelled rows that may be learned from are counted, all their words and pairs of words, and every word whose probability
differs between the classes takes part in every score. The tables stay distributed; what is broadcast are the `shared` most
frequent of these words at most. Where there are more, the occurrences of the rest are joined with their table by a shuffle.
The curve is fitted on about `fit_rows` rows, or all if there are fewer.

Defined results: a null or empty text, or one without words, gets the score of a difference of 0; rows with a null label
or id teach nothing, and an id with several labels counts as toxic if one says so; if one class is missing the score is 0
for all; repeated rows score alike; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import delete, fresh, id_crc, packed, shuffle_partitions, slices, stored, unpacked
from tidegate.llm.words import blocks, mix

THRESHOLD = 0.7
PASSAGE = 4
DISCOUNT = 3
#: Contexts of a word in both classes together below which only shared counts speak.
LEAST = 5
FOLDS = 5
#: Words that are broadcast at most (a hash and six numbers each).
SHARED = 2_000_000
FIT_ROWS = 20_000
_FLUSH = 1_000_000
#: Parts that the pairs of one word are dealt to, and bytes of texts for each bucket of pairs.
SPREAD, BUCKET = 16, 1 << 24
_PAIR = np.dtype([("word", "<u8"), ("before", "<u4"), ("mask", "<u2")])
_RARE = "array<struct<at: int, value: float>>"


def passages(each: np.ndarray) -> tuple[float, float]:
    """Mean difference of a whole text, and of its most toxic passage."""
    if not len(each):
        return 0.0, 0.0
    if len(each) <= PASSAGE:
        return float(each.mean()), float(each.sum() / PASSAGE)
    sums = np.append(0, np.cumsum(each, dtype=np.float64))
    return float(sums[-1] / len(each)), float((sums[PASSAGE:] - sums[:-PASSAGE]).max() / PASSAGE)


@dataclass
class Differences:
    """words: hashes, ascending. values: for each word log P(word | toxic) - log P(word | ordinary), in a column for the
    models without each fold, and a last one for those of all rows. rare: the rest of the table, if it isn't all here."""

    words: np.ndarray
    values: np.ndarray
    rare: DataFrame | None = None

    def of(self, hashes: np.ndarray, column: int) -> tuple[np.ndarray, np.ndarray]:
        """The value of each word (0 for words that tell nothing), and which are here."""
        if not len(self.words):
            return np.zeros(len(hashes)), np.zeros(len(hashes), bool)
        at = np.searchsorted(self.words, hashes)
        at[at == len(self.words)] = 0
        held = self.words[at] == hashes
        return np.where(held, self.values[at, column], 0.0), held


@dataclass
class Toxicity:
    """weights: of the whole text, of the passage, and a constant."""

    table: Differences | None
    weights: tuple[float, float, float] = (0.0, 4.0, -2.0)

    def score(self, whole: np.ndarray, passage: np.ndarray) -> np.ndarray:
        if self.table is None:
            return np.zeros(len(whole))
        a, b, c = self.weights
        return 1 / (1 + np.exp(-np.clip(a * whole + b * passage + c, -60, 60)))


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the columns of x, and a constant, of the likeliest logistic curve, with a slight pull towards 0."""
    scale = np.maximum(x.std(axis=0), 1e-6)
    z = np.column_stack([x / scale, np.ones(len(x))])
    pull = np.append(np.full(x.shape[1], 0.02), 1e-4)
    w = np.zeros(z.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pull), z.T @ (p - y) + pull * w)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return np.append(w[:-1] / scale, w[-1])


def _batch(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _sets() -> list[tuple[int, int]]:
    """Bits of the ordinary and the toxic class, without each fold and in all."""
    both = [[1 << (2 * f + c) for f in range(FOLDS)] for c in (0, 1)]
    return [(sum(both[0]) - both[0][f], sum(both[1]) - both[1][f]) for f in range(FOLDS)] + [(sum(both[0]), sum(both[1]))]


def _distinct(pairs: np.ndarray) -> np.ndarray:
    """Each pair once, in order of word, with all its bits."""
    pairs = pairs[np.lexsort((pairs["before"], pairs["word"]))]
    cuts = np.flatnonzero(np.append(True, (np.diff(pairs["word"]) != 0) | (np.diff(pairs["before"]) != 0))) if len(pairs) else []
    out = pairs[cuts]
    if len(out):
        out["mask"] = np.bitwise_or.reduceat(pairs["mask"], cuts)
    return out


def _pairs(n: int):
    """text, toxic, fold: the different pairs of a word and a hash of the word before it (0: none), with a bit for each fold
    and class that has the pair, by n buckets of the word and some bits of the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        kept = 0

        def out() -> pa.RecordBatch:
            own = _distinct(np.concatenate(held))
            parts = list(packed(own, (mix(own["word"] + own["before"] % np.uint64(SPREAD)) % np.uint64(n)).astype(np.int64)))
            return _batch(bucket=pa.array([p[0] for p in parts], pa.int32()), records=pa.array([p[1] for p in parts], pa.binary()))

        for b in slices(batches):
            toxic, fold = b.column(1).to_pylist(), b.column(2).to_pylist()
            for i, w in blocks(b.column(0).to_pylist()):
                each = np.diff(w.first)
                own = np.empty(len(w.hashes), _PAIR)
                own["word"] = w.hashes
                own["before"][1:] = (w.hashes[:-1] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
                own["before"][w.first[:-1][each > 0]] = 0
                own["mask"] = np.repeat(np.array([1 << (2 * fold[i + k] + toxic[i + k]) for k in range(len(each))], np.uint16), each)
                held.append(own)
                kept += len(own)
                if kept > _FLUSH:
                    yield out()
                    held, kept = [], 0
        if kept:
            yield out()

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Continuation counts of the words of each bucket, from batches sorted by it; one bucket is held at a time."""

    def out(parts: list[bytes]) -> pa.RecordBatch:
        own = _distinct(unpacked(parts, _PAIR))
        cuts = np.flatnonzero(np.append(True, own["word"][1:] != own["word"][:-1]))
        sets = np.array([x for a, b in _sets() for x in (a, b, a | b)], np.uint16)
        counts = np.add.reduceat(((own["mask"][:, None] & sets) != 0).astype(np.int32), cuts, axis=0).astype(np.int32)
        ends = pa.array(np.arange(0, counts.size + 1, len(sets), dtype=np.int32))
        return _batch(word=pa.array(own["word"][cuts].astype(np.int64)), counts=pa.ListArray.from_arrays(ends, pa.array(counts.reshape(-1))))

    now, parts = None, []
    for b in batches:
        for bucket, records in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if bucket != now and parts:
                yield out(parts)
                parts = []
            now = bucket
            parts.append(records)
    if parts:
        yield out(parts)


def word_counts(rows: DataFrame) -> DataFrame:
    """rows: text, toxic, fold. word, and for each of _sets() k the continuation counts n{k}_0, n{k}_1 and n{k} (in either)."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(4 * shuffle_partitions(rows.sparkSession), size // BUCKET)
    pairs = rows.select("text", "toxic", "fold").mapInArrow(_pairs(n), "bucket int, records binary").repartition("bucket").sortWithinPartitions("bucket")
    counts = pairs.mapInArrow(_merged, "word long, counts array<int>")
    names = [c for k in range(FOLDS + 1) for c in (f"n{k}_0", f"n{k}_1", f"n{k}")]
    return counts.groupBy("word").agg(*(F.sum(F.col("counts")[i].cast("long")).alias(c) for i, c in enumerate(names)))


def _clear(k: int, c: int) -> Column:
    """Discounted count of a class, if both have LEAST together."""
    return F.when(F.col(f"n{k}_0") + F.col(f"n{k}_1") >= LEAST, F.greatest(F.col(f"n{k}_{c}") - DISCOUNT, F.lit(0))).otherwise(F.lit(0))


def differences(counts: DataFrame, shared: int = SHARED) -> Differences | None:
    """None if a class has no word."""
    sums = []
    for k in range(FOLDS + 1):
        n = F.col(f"n{k}")
        sums += [F.count_if(n > 0).alias(f"v{k}"), F.sum(n).alias(f"t{k}"), F.sum(F.greatest(n - DISCOUNT, F.lit(0))).alias(f"d{k}")]
        sums += [F.sum(x).alias(f"{name}{k}_{c}") for c in (0, 1) for name, x in (("t", F.col(f"n{k}_{c}")), ("c", _clear(k, c)))]
    total = counts.agg(*sums).first()
    if not total[f"t{FOLDS}_0"] or not total[f"t{FOLDS}_1"]:
        return None
    values = []
    for k in range(FOLDS + 1):
        mass = [total[f"c{k}_{c}"] for c in (0, 1)]
        if not all(mass):
            values.append(F.lit(0.0))
            continue
        backoff = max(1 - mass[c] / total[f"t{k}_{c}"] for c in (0, 1))
        base = (F.greatest(F.col(f"n{k}") - DISCOUNT, F.lit(0)) + (total[f"t{k}"] - total[f"d{k}"]) / total[f"v{k}"]) / total[f"t{k}"]
        p = [backoff * base + (1 - backoff) * _clear(k, c) / mass[c] for c in (0, 1)]
        values.append(F.log(p[1] / p[0]))
    n = F.col(f"n{FOLDS}")
    # What isn't above the discount in either class has the same probability in both.
    told = counts.where((_clear(FOLDS, 0) > 0) | (_clear(FOLDS, 1) > 0))
    steps = [(r.step, r.words) for r in told.groupBy(F.floor(F.log2(n) * 16).alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect()]
    held, least = 0, None
    for step, words in steps:
        held += words
        if held > shared:
            break
        least = step
    table = told.select("word", F.floor(F.log2(n) * 16).alias("step"), F.array(*(v.cast("float") for v in values)).alias("values"))
    near = table.where(F.col("step") >= (F.lit(least) if least is not None else F.lit(1 << 20))).select("word", "values").toArrow()
    word = near.column(0).to_numpy().astype(np.uint64)
    got = near.column(1).combine_chunks().flatten().to_numpy().reshape(-1, FOLDS + 1) if len(word) else np.zeros((0, FOLDS + 1), np.float32)
    order = np.argsort(word)
    rare = None if least == (steps[-1][0] if steps else None) else table.where(F.col("step") < (F.lit(least) if least is not None else F.lit(1 << 20))).select("word", "values")
    return Differences(word[order], got[order], rare)


def _with_rare(df: DataFrame, text_col: str, table: Differences | None, column: Column, name: str) -> DataFrame:
    """df and a last column: places and values of a text's words that aren't broadcast (null: none). column: of the values."""
    if table is None or table.rare is None:
        return df.withColumn(name, F.lit(None).cast(_RARE))
    near = df.sparkSession.sparkContext.broadcast(table.words)

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = Differences(near.value, np.zeros((len(near.value), 1), np.float32))
        for b in slices(batches):
            one, two, col = (b.column(c).to_numpy() for c in range(3))
            for i, w in blocks(b.column(3).to_pylist()):
                n = int(w.first[-1])
                at = np.flatnonzero(~here.of(w.hashes[:n], 0)[1])
                doc = np.searchsorted(w.first, at, side="right") - 1
                yield _batch(one=pa.array(one[i + doc]), two=pa.array(two[i + doc]), col=pa.array(col[i + doc]), word=pa.array(w.hashes[at].astype(np.int64)), at=pa.array((at - w.first[doc]).astype(np.int32)))

    # A text is known by 128 bits of its hashes; copies share their words.
    marks = [F.xxhash64(text_col), F.xxhash64(F.lit(1), F.col(text_col))]
    asked = df.where(F.col(text_col).isNotNull()).select(marks[0].alias("one"), marks[1].alias("two"), column.cast("int").alias("col"), F.col(text_col).alias("text"))
    found = asked.mapInArrow(occurrences, "one long, two long, col int, word long, at int").join(table.rare, "word")
    found = found.groupBy("one", "two", "col").agg(F.collect_set(F.struct("at", F.get("values", F.col("col")).alias("value"))).alias(name))
    one, two, col = (fresh(df, n) for n in ("one", "two", "col"))
    found = found.select(F.col("one").alias(one), F.col("two").alias(two), F.col("col").alias(col), name)
    keyed = df.withColumn(one, marks[0]).withColumn(two, marks[1]).withColumn(col, column.cast("int"))
    return keyed.join(found, [one, two, col], "left").select(*df.columns, name)


def _measured(texts: list, rare: list, columns: list[int], table: Differences) -> tuple[np.ndarray, np.ndarray]:
    """Differences of whole texts and of their most toxic passages."""
    whole, passage = np.zeros(len(texts)), np.zeros(len(texts))
    for i, w in blocks(texts):
        of = {c: table.of(w.hashes, c)[0] for c in set(columns[i : i + len(w.first) - 1])}
        for k in range(len(w.first) - 1):
            each = of[columns[i + k]][w.first[k] : w.first[k + 1]]
            for r in rare[i + k] or ():
                each[r["at"]] = r["value"]
            whole[i + k], passage[i + k] = passages(each)
    return whole, passage


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, shared: int = SHARED) -> Toxicity:
    """docs: doc_id, text. labels: doc_id, toxic. All labelled rows of docs are counted."""
    spark = docs.sparkSession
    said = labels.where("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(said.hint("merge"), "doc_id")  # labels grow with the documents
    rows, folder = stored(rows.select("text", "toxic", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold")), "labelled")
    try:
        counts, counted = stored(word_counts(rows), "word-counts")
        table = differences(counts, shared)
        if table is None or table.rare is None:  # else it is read whenever scores are
            delete(spark, counted)
        return Toxicity(None) if table is None else Toxicity(table, _curve(spark, rows, table, fit_rows))
    finally:
        delete(spark, folder)


def _curve(spark, rows: DataFrame, table: Differences, fit_rows: int) -> tuple[float, float, float]:
    # A hash of the text draws about fit_rows rows where there are more; no task needs to see the others.
    drawn = F.pmod(F.xxhash64(F.lit(3), "text"), F.lit(1_000_000)) < F.lit(int(1_000_000 * min(1.0, fit_rows / max(rows.count(), 1))))
    asked = _with_rare(rows.where(drawn), "text", table, F.col("fold"), "rare")
    broadcast = spark.sparkContext.broadcast(Differences(table.words, table.values))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            whole, passage = _measured(b.column(0).to_pylist(), b.column(3).to_pylist(), b.column(2).to_pylist(), broadcast.value)
            yield _batch(whole=pa.array(whole), passage=pa.array(passage), toxic=b.column(1))

    got = asked.select("text", "toxic", "fold", "rare").mapInArrow(measure, "whole double, passage double, toxic int").toArrow()
    y = got.column("toxic").to_numpy().astype(float)
    if y.sum() == 0 or y.sum() == len(y):
        return Toxicity(None).weights
    return tuple(map(float, logistic(np.column_stack([got.column(c).to_numpy() for c in ("whole", "passage")]), y)))


def scores(docs: DataFrame, model: Toxicity, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, whole, passage (the differences that the score is made of)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(id_crc("doc_id") % 3 == 1, F.lit(False)).alias("held_out"), "text")
    rows = _with_rare(rows, "text", model.table, F.lit(FOLDS), "rare")
    judge = _judge(docs, model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            whole, passage, found = judge(b.column(2).to_pylist(), b.column(3).to_pylist())
            yield _batch(doc_id=b.column(0), held_out=b.column(1), score=pa.array(found), whole=pa.array(whole), passage=pa.array(passage))

    found = rows.mapInArrow(score, "doc_id long, held_out boolean, score double, whole double, passage double")
    return found.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "whole", "passage")


def _judge(docs: DataFrame, model: Toxicity):
    """Differences and scores of texts, by a broadcast model."""
    table = model.table and Differences(model.table.words, model.table.values[:, -1:])
    shared = docs.sparkSession.sparkContext.broadcast(Toxicity(table, model.weights))

    def judge(texts: list, rare: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        known = shared.value
        if known.table is None:
            return (np.zeros(len(texts)),) * 3
        whole, passage = _measured(texts, rare, [0] * len(texts), known.table)
        return whole, passage, known.score(whole, passage)

    return judge


def learned_from(docs: DataFrame, labels: DataFrame) -> Toxicity:
    """Learns from the rows that are not held out."""
    return learn(docs.where(id_crc("doc_id") % 3 != 1), labels)


def learn_and_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scores(docs, learned_from(docs, labels))


def ordinary(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns."""
    model = learned_from(docs, labels)
    judge = _judge(docs, model)
    name = fresh(docs, "rare")
    rows = _with_rare(docs, "text", model.table, F.lit(FOLDS), name)
    at = docs.columns.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            _, _, found = judge(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist())
            yield b.select(b.schema.names[:-1]).filter(pa.array(found < threshold))

    return rows.mapInArrow(clean, docs.schema)
