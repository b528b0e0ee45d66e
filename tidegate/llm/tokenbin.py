"""Token-id shards with a minimal perfect hash index.

Documents are range-partitioned and sorted by id; each partition becomes shard files in the shared folder, a new one
after every SHARD ids or so, so that a task holds no more than one shard:

    magic "TGSHARD1", uint32 version 1, uint32 bytes per id, uint64 rows, uint64 ids,
    row ids (int64), row flags (uint8, 1: the row's id is null), row offsets (uint64, rows + 1 of them, in ids),
    uint64 keys, uint64 buckets, uint64 seed, bucket displacements (uint32),
    fingerprints (uint32, by slot), first rows (uint64, by slot), row counts (uint64, by slot),
    ids (little-endian, uint16 for this vocabulary)

The index is a hash-and-displace minimal perfect hash: a key's bucket gives a displacement, key and displacement give one
of exactly as many slots as there are keys, and the slot's fingerprint tells a stored key from a foreign one. A lookup
(`Keyed.get`) reads two heads, one displacement, one slot and one pair of offsets by seeks, whatever the shard's size. A
manifest row for each shard (path, place, first and last id, rows, ids) leads from a key to its shard and gives the ids
before each shard; `lookup` finds the ids of a table of keys.

Each attempt at a task writes a file of its own name and returns that name; only the names in the manifest are read, so
lost executors and repeated tasks leave no half-written shard in use. Files go through pyarrow's file systems, so the
shared folder may be in any store that these reach.

Defined results: a null text counts as empty and has the end id alone; rows that share an id are in the order of a hash of
their texts, then of the texts, and one index entry of a shard covers all that it has of them; null ids come first and are stored, but can't be looked up by key; an empty table
has an empty manifest; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm.bpe import encoder
from tidegate.llm.common import cut, delete, shared_path, slices

MAGIC = b"TGSHARD1"
_HEAD = struct.Struct("<8sIIQQ")
_INDEX = struct.Struct("<QQQ")
MANIFEST = "path string, pid int, part int, first_id long, last_id long, n_rows long, n_ids long"
#: Ids of a shard, after which the next begins (a longer document isn't cut).
SHARD = 1 << 25


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64 well-mixed bits of each key."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@dataclass
class PerfectHash:
    seed: int
    shift: np.ndarray
    n: int

    @classmethod
    def build(cls, keys: np.ndarray, per_bucket: int = 4) -> "PerfectHash":
        """keys: distinct. Large buckets are placed first; each tries displacements until all its keys find free slots."""
        n = len(keys)
        if not n:
            return cls(0, np.zeros(0, np.uint32), 0)
        for seed in range(64):
            h = mixed(keys, seed)
            buckets = max(1, n // per_bucket)
            bucket = (h >> np.uint64(32)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            counts = np.bincount(bucket.astype(np.int64), minlength=buckets)
            ends = np.cumsum(counts)
            taken = np.zeros(n, bool)
            shift = np.zeros(buckets, np.uint32)
            done = True
            for b in np.argsort(-counts, kind="stable"):
                if not counts[b]:
                    break
                own = h[order[ends[b] - counts[b] : ends[b]]]
                for d in range(0, 1 << 24, 256):
                    tried = cls._slots(own[None, :], np.arange(d, d + 256, dtype=np.uint64)[:, None], n)
                    free = ~taken[tried].any(axis=1)
                    if counts[b] > 1:
                        line = np.sort(tried, axis=1)
                        free &= (line[:, 1:] != line[:, :-1]).all(axis=1)
                    if free.any():
                        k = int(np.argmax(free))
                        shift[b] = d + k
                        taken[tried[k]] = True
                        break
                else:
                    done = False
                    break
            if done:
                return cls(seed, shift, n)
        raise ValueError("keys repeat: no perfect hash exists")

    @staticmethod
    def _slots(h: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = h ^ (d * np.uint64(0xD6E8FEB86659FD93))
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            return ((x ^ (x >> np.uint64(32))) % np.uint64(n)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        h = mixed(keys, self.seed)
        d = self.shift[((h >> np.uint64(32)) % np.uint64(len(self.shift))).astype(np.int64)].astype(np.uint64)
        return self._slots(h, d, self.n)

    @staticmethod
    def fingerprints(keys: np.ndarray) -> np.ndarray:
        return (mixed(keys, 977) >> np.uint64(16)).astype(np.uint32)


def write_shard(out, row_ids: np.ndarray, nulls: np.ndarray, sizes: np.ndarray, payload, width: int) -> None:
    """payload: the id arrays of the rows, in order."""
    offsets = np.append(0, np.cumsum(sizes)).astype("<u8")
    keyed = np.flatnonzero(~nulls)
    keys, first, count = np.unique(row_ids[keyed], return_index=True, return_counts=True)
    ph = PerfectHash.build(keys)
    slots = ph.slots(keys) if len(keys) else np.zeros(0, np.int64)
    prints, rows, counts = np.zeros(ph.n, "<u4"), np.zeros(ph.n, "<u8"), np.zeros(ph.n, "<u8")
    prints[slots], rows[slots], counts[slots] = ph.fingerprints(keys), keyed[first] if len(keyed) else first, count
    out.write(_HEAD.pack(MAGIC, 1, width, len(row_ids), int(offsets[-1])))
    for a in (row_ids.astype("<i8"), nulls.astype("u1"), offsets):
        out.write(a.tobytes())
    out.write(_INDEX.pack(ph.n, len(ph.shift), ph.seed))
    for a in (ph.shift.astype("<u4"), prints, rows, counts):
        out.write(a.tobytes())
    for a in payload:
        out.write(a.astype(f"<u{width}", copy=False).tobytes())


class Shard:
    """A shard file opened for keyed reads; the index is read once, ids are read as asked for."""

    def __init__(self, file) -> None:
        self.file = file
        magic, version, self.width, rows, self.n_ids = _HEAD.unpack(file.read(_HEAD.size))
        if magic != MAGIC or version != 1:
            raise ValueError("not a token shard")
        take = lambda kind, n: np.frombuffer(file.read(np.dtype(kind).itemsize * n), kind)
        self.row_ids, self.nulls, self.offsets = take("<i8", rows), take("u1", rows) == 1, take("<u8", rows + 1).astype(np.int64)
        n, buckets, seed = _INDEX.unpack(file.read(_INDEX.size))
        self.hash = PerfectHash(seed, take("<u4", buckets), n)
        self.prints, self.rows, self.counts = take("<u4", n), take("<u8", n).astype(np.int64), take("<u8", n).astype(np.int64)
        self.base = file.tell()

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row of each key and the number of its rows; no rows for a key whose fingerprint isn't stored."""
        if not self.hash.n:
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        slots = self.hash.slots(keys)
        held = self.prints[slots] == self.hash.fingerprints(keys)
        return self.rows[slots], np.where(held, self.counts[slots], 0)

    def ids(self, row: int, rows: int = 1) -> np.ndarray:
        a, b = int(self.offsets[row]), int(self.offsets[row + rows])
        self.file.seek(self.base + a * self.width)
        return np.frombuffer(self.file.read((b - a) * self.width), f"<u{self.width}")


class Keyed:
    """A shard file opened for single keys: what a lookup reads doesn't depend on the shard's size."""

    def __init__(self, file) -> None:
        self.file = file
        magic, version, self.width, rows, _ = _HEAD.unpack(self._read(0, _HEAD.size))
        if magic != MAGIC or version != 1:
            raise ValueError("not a token shard")
        self.offsets = _HEAD.size + 9 * rows
        head = self.offsets + 8 * (rows + 1)
        self.n, self.buckets, self.seed = _INDEX.unpack(self._read(head, _INDEX.size))
        self.shifts = head + _INDEX.size
        self.prints = self.shifts + 4 * self.buckets
        self.rows = self.prints + 4 * self.n
        self.counts = self.rows + 8 * self.n
        self.ids = self.counts + 8 * self.n

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def _one(self, at: int, kind: str) -> int:
        return int(np.frombuffer(self._read(at, np.dtype(kind).itemsize), kind)[0])

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of each document of a key; none if the shard doesn't have it."""
        if not self.n:
            return []
        own = np.array([key], np.int64)
        h = mixed(own, self.seed)
        shift = self._one(self.shifts + 4 * int((h[0] >> np.uint64(32)) % np.uint64(self.buckets)), "<u4")
        slot = int(PerfectHash._slots(h, np.array([shift], np.uint64), self.n)[0])
        if self._one(self.prints + 4 * slot, "<u4") != int(PerfectHash.fingerprints(own)[0]):
            return []
        row, count = self._one(self.rows + 8 * slot, "<u8"), self._one(self.counts + 8 * slot, "<u8")
        # A fingerprint is 32 bits: the stored id tells the last foreign keys.
        if self._one(_HEAD.size + 8 * row, "<i8") != key:
            return []
        at = np.frombuffer(self._read(self.offsets + 8 * row, 8 * (count + 1)), "<u8").astype(np.int64)
        payload = np.frombuffer(self._read(self.ids + int(at[0]) * self.width, int(at[-1] - at[0]) * self.width), f"<u{self.width}")
        return np.split(payload, at[1:-1] - at[0])


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_shards(docs: DataFrame, folder: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", width: int = 2, size: int = SHARD) -> DataFrame:
    """Writes all documents in ascending id order and returns the manifest, checkpointed: one row per shard."""

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        ids, sizes, payload, held, part = [], [], [], 0, 0

        def written() -> pa.RecordBatch:
            nulls = np.array([i is None for i in ids])
            row_ids = np.array([i or 0 for i in ids], np.int64)
            store, at = _store(folder)
            store.create_dir(at, recursive=True)
            name = f"{pid:06d}-{part:04d}-{uuid.uuid4().hex}.ids"
            with store.open_output_stream(f"{at}/{name}") as out:
                write_shard(out, row_ids, nulls, np.array(sizes, np.int64), payload, width)
            own = row_ids[~nulls]
            row = (f"{folder}/{name}", pid, part, int(own[0]) if len(own) else None, int(own[-1]) if len(own) else None, len(ids), held)
            kinds = (pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 4)
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(row, kinds)], names=[c.split()[0] for c in MANIFEST.split(", ")])

        for b in slices(batches):
            for i, got in zip(b.column(0).to_pylist(), encoder(vocabulary).encode([t or "" for t in b.column(1).to_pylist()])):
                ids.append(i)
                sizes.append(len(got) + 1)
                payload.append(np.append(got, end_id).astype(f"<u{width}"))
                held += len(got) + 1
                if held >= size:
                    yield written()
                    ids, sizes, payload, held, part = [], [], [], 0, part + 1
        if ids:
            yield written()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # Rows that share an id, however many, are dealt out by a hash of their texts.
    order = [F.col("doc_id"), F.xxhash64("text")]
    return cut(rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").mapInArrow(shard, MANIFEST))


def read_shards(manifest: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32. Every keyed row is found through the index."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, before in zip(b.column("path").to_pylist(), b.column("before").to_pylist()):
                store, at = _store(path)
                with store.open_input_file(at) as file:
                    s = Shard(file)
                    row, rows = s.find(s.row_ids)
                    nth = np.arange(len(row)) - row
                    wrong = ~s.nulls & ((rows < 1) | (nth < 0) | (nth >= rows))
                    if wrong.any():
                        raise ValueError(f"{path}: the index has no entry for {s.row_ids[wrong][:3]}")
                    place = np.where(s.nulls, np.arange(len(row)), row + nth)
                    size = s.offsets[place + 1] - s.offsets[place]
                    crc = [zlib.crc32(s.ids(int(r)).astype("<u4").tobytes()) for r in place]
                    yield pa.RecordBatch.from_arrays([pa.array(s.row_ids, pa.int64(), mask=s.nulls), pa.array(before + s.offsets[place]), pa.array(size), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spark: SparkSession = manifest.sparkSession
    shards = sorted(manifest.collect(), key=lambda r: (r.pid, r.part))  # a row for each shard file
    before, rows = 0, []
    for r in shards:
        rows.append((r.path, before))
        before += r.n_ids
    listed = spark.createDataFrame(rows, "path string, before long")
    return listed.repartition(max(1, len(rows))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """keys: key long. One row for each key and document of it: key, nth (among the key's documents), ids; no row for a key
    that isn't stored. What is broadcast is a row for each shard; each key reads a bounded number of places of its shards."""
    spark: SparkSession = manifest.sparkSession
    shards = sorted((r for r in manifest.collect() if r.first_id is not None), key=lambda r: (r.pid, r.part))
    shared = spark.sparkContext.broadcast(([r.path for r in shards], np.array([r.first_id for r in shards], np.int64), np.array([r.last_id for r in shards], np.int64)))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, first, last = shared.value
        at, opened = None, None
        for b in batches:
            out: list[tuple] = []
            for key in b.column(0).to_pylist():
                found = []
                for k in range(int(np.searchsorted(last, key)), int(np.searchsorted(first, key, side="right"))):
                    if k != at:
                        store, place = _store(paths[k])
                        at, opened = k, Keyed(store.open_input_file(place))
                    found += opened.get(key)
                out += [(key, n, own.tolist()) for n, own in enumerate(found)]
            columns = list(zip(*out)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.list_(pa.int32())))], names=["key", "nth", "ids"])

    # Keys in order stay with one shard for long.
    held = keys.select(F.col("key").cast("long").alias("key")).where("key is not null")
    return held.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(find, "key long, nth int, ids array<int>")


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Writes the shards, reads every document back from them, and deletes them."""
    folder = shared_path(docs.sparkSession, "token-shards")
    try:
        return cut(read_shards(write_shards(docs, folder, vocabulary, end_id)))
    finally:
        delete(docs.sparkSession, folder)
