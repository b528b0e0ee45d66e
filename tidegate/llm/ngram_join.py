"""N-gram Jaccard self-join with Bayesian candidate pruning.

1. Every text becomes its set of five-word shingles. Texts with one and the same set form a class, known by its digest (its
   representative is the row of least id), so copies are never compared with each other.
2. Classes meet in buckets of MinHash bands (28 bands of 5: a pair of similarity 0.8 meets nowhere with a probability of
   1.5e-5, one of 0.85 of 7e-8). Buckets with the same members are looked at once.
3. In a bucket, MinHash values are compared 20 at a time; a pair is dropped as soon as the posterior probability that its
   similarity reaches the threshold (uniform prior) falls below 1e-6. The pairs left link their members; a spanning
   forest of them is all that leaves the task.
4. Members that such links connect meet once more, now with their texts. Their MinHash values are compared in the same way,
   and the pairs that survive, these alone, are verified exactly on whole shingle sets. Links that hold are counted for
   each member, and classes of near copies are the components of the links that hold.

Buckets and components of more than CHUNK members are dealt out by pairs of chunks, so no task holds more than two chunks
of any group, whatever its size, and no link is lost. No pair of documents is ever a row.

Defined results: a null or empty text, or one without words, is like no other (its own class, no links); a text of one to
four words has one shingle, its words; rows that share an id are told apart by their texts, each a document of the class
of its own text; a row with a null id gets a null class and no links; ties don't matter, as every pair at or above the
threshold counts; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm.common import cut, fresh, slices
from tidegate.llm.components import components, forest
from tidegate.llm.words import Words, blocks, shingles

WORDS, BANDS, ROWS = 5, 28, 5
HASHES = BANDS * ROWS
STEP = 20
TOLERANCE = 1e-6
CHUNK = 512
#: The threshold as a fraction of whole numbers, so that verification is exact.
NUMERATOR, DENOMINATOR = 4, 5


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(0, 1 << 31, (HASHES, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, (HASHES, 1), dtype=np.uint32)


_A, _B = _multipliers()


def signature(own: np.ndarray) -> np.ndarray:
    """The low 16 bits of the least value of each hash function over a set (a chance match of two has 1 in 65,536)."""
    x = (own >> np.uint64(32)).astype(np.uint32) ^ own.astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 4096):
        np.minimum(low, (x[k : k + 4096] * _A + _B).min(axis=1), out=low)
    low ^= low >> np.uint32(16)
    return low.astype("<u2")


def least_matches(threshold: float, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(values compared, least number of equal ones): with fewer, P(similarity >= threshold) is below the tolerance.

    Under a uniform prior the posterior is a beta distribution, whose upper tail is a binomial sum."""
    out = []
    for h in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, 0
        while True:
            tail += comb(h + 1, m) * threshold**m * (1 - threshold) ** (h + 1 - m)
            if tail >= tolerance:
                break
            m += 1
        out.append((h, m))
    return out


def _table(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], names=list(kinds))


def digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        texts = b.column(2).to_pylist()
        digests, signs = [], []
        for i, w in blocks(texts):
            for k in range(len(w.first) - 2 + 1):
                own = shingles(w.of(k), WORDS)
                digests.append(digest(own) if len(own) else None)
                signs.append(signature(own).tobytes() if len(own) else None)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(digests, pa.binary()), pa.array(signs, pa.binary())], names=["doc_id", "mark", "digest", "sign"])


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows of each key in turn, from batches that are sorted by it."""
    now, rows = None, []
    for b in batches:
        for r in b.to_pylist():
            key = tuple(r[k] for k in keys)
            if key != now:
                if rows:
                    yield now, rows
                now, rows = key, []
            rows.append(r)
    if rows:
        yield now, rows


def dealt(df: DataFrame, key: str, size: str, member: str, chunk: int = CHUNK) -> DataFrame:
    """Groups of more than `chunk` members (by column size) as pairs of chunks: rows gain lo, hi and own, the row's chunk."""
    n = F.ceil(F.col(size) / chunk).cast("int")
    own = F.pmod(F.xxhash64(F.lit(17), F.col(member)), n).cast("int")
    rows = df.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    rows = rows.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("other")
    return rows.repartition(F.col(key), F.col("lo"), F.col("hi")).sortWithinPartitions(key, "lo", "hi", member)


def survivors(signs: np.ndarray, side: np.ndarray | None, need: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Pairs that pruning leaves. side: of each member, if only pairs between the two sides count."""
    left, right = [], []
    for i in range(len(signs) - 1):
        at = np.arange(i + 1, len(signs))
        if side is not None:
            at = at[side[at] != side[i]]
        equal = np.zeros(len(at), np.int64)
        done = 0
        for h, least in need:
            if not len(at):
                break
            equal += (signs[at, done:h] == signs[i, done:h]).sum(axis=1)
            keep = equal >= least
            at, equal, done = at[keep], equal[keep], h
        left += [i] * len(at)
        right += at.tolist()
    return left, right


def _prune(threshold: float) -> Callable:
    need = least_matches(threshold)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"a": pa.binary(), "b": pa.binary()}
        out: list[tuple] = []
        for (_, lo, hi), rows in groups(batches, ["key", "lo", "hi"]):
            signs = np.frombuffer(b"".join(r["sign"] for r in rows), "<u2").reshape(len(rows), HASHES)
            side = np.array([r["own"] for r in rows]) if lo != hi else None
            _, used = forest(len(rows), *survivors(signs, side, need))
            out += [(rows[i]["digest"], rows[j]["digest"]) for i, j in used]
            if len(out) > 20_000:
                yield _table(out, kinds)
                out = []
        if out:
            yield _table(out, kinds)

    return prune


def common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sets."""
    n, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    if 20 * len(left) < n * n:  # few pairs: one by one
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(left.tolist(), right.tolist())], np.int64)
    owner = np.repeat(np.arange(n), sizes)
    values, back, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # A shingle that one set alone has is in no intersection.
    place = np.cumsum(counts > 1) - 1
    held = counts[back] > 1
    owner, column = owner[held], place[back[held]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((n, n), np.float32)
    total, width = int(place[-1]) + 1 if len(place) else 0, 4096
    for start in range(0, total, width):
        a, b = np.searchsorted(column, [start, start + width])
        m = np.zeros((n, width), np.float32)
        m[owner[a:b], column[a:b] - start] = 1
        both += m @ m.T
    return np.rint(both[left, right]).astype(np.int64)


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, top: int = NUMERATOR, bottom: int = DENOMINATOR) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs whose Jaccard similarity is top / bottom or more, exactly."""
    sizes = np.array([len(s) for s in sets], np.int64)
    c = common(sets, left, right)
    holds = (c > 0) & (bottom * c >= top * (sizes[left] + sizes[right] - c))
    return left[holds], right[holds]


_FOUND = {"digest": pa.binary(), "links": pa.int64(), "link_docs": pa.int64(), "label": pa.binary(), "other": pa.binary()}


def _verify(top: int, bottom: int) -> Callable:
    need = least_matches(top / bottom)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (_, lo, hi), rows in groups(batches, ["comp", "lo", "hi"]):
            sets: list[np.ndarray] = []
            for _, w in blocks([r["text"] for r in rows]):
                sets += [shingles(w.of(k), WORDS) for k in range(len(w.first) - 1)]
            signs = np.frombuffer(b"".join(r["sign"] for r in rows), "<u2").reshape(len(rows), HASHES)
            side = np.array([r["own"] for r in rows]) if lo != hi else None
            i, j = linked(sets, *(np.array(p, np.int64) for p in survivors(signs, side, need)), top, bottom)
            copies = np.array([r["copies"] for r in rows], np.int64)
            n = np.bincount(i, minlength=len(rows)) + np.bincount(j, minlength=len(rows))
            docs = np.bincount(i, copies[j], minlength=len(rows)) + np.bincount(j, copies[i], minlength=len(rows))
            roots, used = forest(len(rows), i.tolist(), j.tolist())
            alone = rows[0]["members"] <= CHUNK  # the whole component is here, in order of digest
            out += [(r["digest"], int(n[k]), int(docs[k]), rows[roots[k]]["digest"] if alone else None, None) for k, r in enumerate(rows)]
            if not alone:
                out += [(rows[a]["digest"], 0, 0, None, rows[b]["digest"]) for a, b in used]
            if len(out) > 20_000:
                yield _table(out, _FOUND)
                out = []
        if out:
            yield _table(out, _FOUND)

    return verify


def _matched(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """One row per row of docs (doc_id, mark, digest), and one per class: digest, rep (its first row's doc_id and mark), head
    (that of the class of near copies), copies, links, link_docs. mark: a hash of the text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    sets = cut(rows.mapInArrow(_sets, "doc_id long, mark long, digest binary, sign binary"))
    keyed = sets.where("digest is not null and doc_id is not null")
    classes = cut(keyed.groupBy("digest").agg(F.min(F.struct("doc_id", "mark")).alias("rep"), F.count("*").alias("copies"), F.first("sign").alias("sign")))

    # Buckets of bands: what is shuffled first is a key and a digest.
    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))
    members = classes.select("digest", "sign", band.alias("band"))
    members = members.select("digest", F.expr(f"xxhash64(band, substring(sign, band * {2 * ROWS} + 1, {2 * ROWS}))").alias("key"))
    buckets = members.groupBy("key").agg(F.count("*").alias("n"), F.min("digest").alias("first"), F.bit_xor(F.xxhash64("digest")).alias("who")).where("n > 1")
    buckets = buckets.groupBy("n", "first", "who").agg(F.min("key").alias("key"))  # the same members: once
    inside = members.join(buckets.select("key", "n"), "key").join(classes.select("digest", "sign"), "digest")
    edges = dealt(inside, "key", "n", "digest").select("key", "lo", "hi", "own", "digest", "sign").mapInArrow(_prune(NUMERATOR / DENOMINATOR), "a binary, b binary")
    candidates = cut(components(edges).select(F.col("label").alias("comp"), F.col("node").alias("digest")))

    # Exact verification. A class is known by its digest; one row of its own, by id and mark, brings the text.
    sized = candidates.groupBy("comp").agg(F.count("*").alias("members"))
    wanted = candidates.join(sized, "comp").join(classes, "digest").select("comp", "members", "copies", "digest", "sign", "rep.*")
    texts = rows.join(wanted, ["doc_id", "mark"]).dropDuplicates(["digest"])
    found = dealt(texts, "comp", "members", "digest").select("comp", "lo", "hi", "own", "members", "copies", "digest", "sign", "text")
    found = cut(found.mapInArrow(_verify(NUMERATOR, DENOMINATOR), "digest binary, links long, link_docs long, label binary, other binary"))
    links = found.groupBy("digest").agg(F.sum("links").alias("links"), F.sum("link_docs").alias("link_docs"), F.min("label").alias("label"))
    spread = found.where("other is not null").select(F.col("digest").alias("a"), F.col("other").alias("b"))
    if spread.take(1):
        own = components(spread).select(F.col("node").alias("digest"), F.col("label").alias("wide"))
        links = links.join(own, "digest", "left").select("digest", "links", "link_docs", F.coalesce("wide", "label").alias("label"))
    linked_classes = classes.select("digest", "rep", "copies").join(links, "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    heads = linked_classes.groupBy("label").agg(F.min("rep").alias("head"))
    known = linked_classes.join(heads, "label").select("digest", "rep", "head", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("link_docs", F.lit(0)).alias("link_docs"))
    return sets.select("doc_id", "mark", "digest"), known


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, rep_id, class_id, n_links, n_linked_texts.

    rep_id: least id with the same shingles. class_id: least id of the class of near copies. n_links: other documents at
    or above the threshold, copies included; n_linked_texts: other shingle sets at or above it."""
    rows, known = _matched(docs, id_col, text_col)
    copy = F.col("rep").isNotNull() & F.col("doc_id").isNotNull()
    return rows.join(known, "digest", "left").select(
        "doc_id",
        F.when(copy, F.col("rep.doc_id")).otherwise(F.col("doc_id")).alias("rep_id"),
        F.when(copy, F.col("head.doc_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(copy, F.col("copies") - 1 + F.col("link_docs")).otherwise(F.lit(0)).alias("n_links"),
        F.when(copy, F.col("links")).otherwise(F.lit(0)).alias("n_linked_texts"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each class of near copies, the first by id and then by a hash of its text, with all its columns.
    Rows with a null id and rows without words stay, all of them; of rows repeated in id and text, one."""
    rows, known = _matched(docs, id_col, text_col)
    stay = known.select("head.doc_id", "head.mark").distinct()
    wordless = rows.where("digest is null and doc_id is not null").select("doc_id", "mark").distinct()
    own, mark, nth = (fresh(docs, n) for n in ("own", "mark", "nth"))
    kept = stay.withColumn(nth, F.lit(1)).unionByName(wordless.withColumn(nth, F.lit(None).cast("int")))
    kept = kept.select(F.col("doc_id").alias(own), F.col("mark").alias(mark), nth)
    keyed = docs.where(F.col(id_col).isNotNull()).withColumn(own, F.col(id_col).cast("long")).withColumn(mark, F.xxhash64(text_col))
    held = keyed.join(kept, [own, mark])
    first = held.where(F.col(nth) == 1).withColumn(nth, F.row_number().over(Window.partitionBy(own, mark).orderBy(own))).where(F.col(nth) == 1)
    return first.select(*docs.columns).unionByName(held.where(F.col(nth).isNull()).select(*docs.columns)).unionByName(docs.where(F.col(id_col).isNull()))
