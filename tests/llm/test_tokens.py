from __future__ import annotations

import io
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidegate.llm import bpe
from tidegate.llm.packing import Capacity, best_fit, plan
from tidegate.llm.common import delete, shared_path
from tidegate.llm.tokenbin import Keyed, PerfectHash, Shard, lookup, read_shards, round_trip, write_shard, write_shards

PATH = bpe.vocabulary()
LIBRARY = Tokenizer.from_file(PATH)
END = "<|endoftext|>"
MARKED = [END, f"{END} a", f"a {END}", f"a{END}b", f"{END}{END}", f" {END} {END}  x", f"a  {END}'s", f"it'{END}s", "<|endof", "text|>", f"x {END[:-1]} {END}"]
TEXTS = [*MARKED, "it's we'll don't 's ' s", "  two  blanks \n\n x", "", "tab\t\tx 12½ ²", "日本語 テスト　x", "naïve café!!! $5.00", "x" * 3000, "a 1 ?" * 2000]


def want(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab'stmdlverST2½_., !\n\t é日　", max_size=30), max_size=8))
def test_ids_equal_the_library(texts):
    assert [list(x) for x in bpe.encoder(PATH).encode(texts)] == [want(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from([END, "<|endof", "text|>", "a", " ", "'s", "'", "\n", "12", "é"]), max_size=12).map("".join), max_size=6))
def test_added_tokens_are_the_library_s(texts):
    assert [list(x) for x in bpe.encoder(PATH).encode(texts)] == [want(t) for t in texts]


def test_code_points_left_out_are_unassigned_or_private():
    import sys
    import unicodedata

    listed = set(bpe.assigned())
    assert {unicodedata.category(chr(c)) for c in range(sys.maxunicode + 1) if c not in listed} <= {"Cn", "Co"}


def test_long_texts_and_forgetting():
    e = bpe.ByteBpe(PATH, remembered=50)
    assert [list(x) for x in e.encode(TEXTS)] == [want(t) for t in TEXTS]
    text = "ab, it's cd\n" * 400
    parts = bpe.long_parts(text, 100)
    assert "".join(parts) == text and len(parts) > 10
    assert [i for p in parts for i in want(p)] == want(text)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_shards_round_trip(spark, frame, empty):
    texts = [*TEXTS, None] * 4
    docs = frame(texts)
    start, expected = 0, []
    for i, t in enumerate(texts):
        ids = [*want(t), 2]
        expected.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, round_trip(docs, PATH).collect())) == expected
    assert round_trip(empty, PATH).count() == 0
    odd = spark.createDataFrame([(5, "b"), (5, "a"), (None, "c"), (5, "a")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.start) for r in round_trip(odd, PATH).collect()) == [(-1, 0), (5, 2), (5, 4), (5, 6)]


def test_index_is_minimal_and_knows_foreign_keys():
    keys = np.unique(np.random.default_rng(3).integers(-(1 << 60), 1 << 60, 5000))
    ph = PerfectHash.build(keys)
    assert sorted(ph.slots(keys)) == list(range(len(keys)))
    out = io.BytesIO()
    write_shard(out, keys, np.zeros(len(keys), bool), np.full(len(keys), 2), [np.array([k % 1000, 2], "<u2") for k in range(len(keys))], 2)
    out.seek(0)
    s = Shard(out)
    row, rows = s.find(keys)
    assert (row == np.arange(len(keys))).all() and (rows == 1).all()
    assert list(s.ids(int(row[1234]))) == [234, 2]
    assert s.find(keys + 1)[1].sum() <= 2  # a foreign key is told by its 32-bit fingerprint


def test_lookup_by_key(spark):
    """Through manifest and index, with many shards, a key whose documents lie in several, nulls and foreign keys."""
    rows = [(3 * k - 300, f"text {k} {'word ' * (k % 7)}") for k in range(400)] + [(900, f"same {k}") for k in range(60)] + [(None, "no id"), (901, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    folder = shared_path(spark, "lookup")
    manifest = write_shards(docs, folder, PATH, 2, size=200)
    assert manifest.count() > 10 and manifest.agg({"n_ids": "max"}).first()[0] < 300
    keys = spark.createDataFrame([(i,) for i in [-300, -297, -299, 0, 900, 897, 901, 902, -10_000, 10_000, None]], "key long")
    got = defaultdict(list)
    for r in lookup(manifest, keys).collect():
        got[r.key].append(list(r.ids))
    held = defaultdict(list)
    for i, t in rows:
        held[i].append([*want(t), 2])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(held[k]) for k in (-300, -297, 0, 900, 897, 901)}
    assert sorted(r.doc_id or 0 for r in read_shards(manifest).collect()) == sorted(i or 0 for i, _ in rows)
    assert lookup(manifest.where("n_rows < 0"), keys).count() == 0
    delete(spark, folder)


def test_a_lookup_reads_the_same_few_places_in_shards_of_any_size():
    read = {}
    for n in (10, 100_000):
        keys = np.arange(n, dtype=np.int64) * 7
        out = io.BytesIO()
        write_shard(out, keys, np.zeros(n, bool), np.full(n, 3), [np.array([k % 1000, 5, 2], "<u2") for k in range(n)], 2)

        class Counted(io.BytesIO):
            total = calls = 0

            def read(self, size=-1):
                Counted.total, Counted.calls = Counted.total + size, Counted.calls + 1
                return super().read(size)

        file = Counted(out.getvalue())
        assert [x.tolist() for x in Keyed(file).get(21)] == [[3, 5, 2]]
        read[n] = Counted.total, Counted.calls
        assert Keyed(file).get(22) == [] and Keyed(file).get(-1) == []
    assert read[10] == read[100_000] and read[10][0] < 150


def check_packing(rows, cap, lengths=None):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= cap.tokens and len(own) <= cap.documents and sum(n * n for _, n in own) <= cap.attention
    return len(bins)


def test_packing(frame, empty):
    texts = ["word " * n for n in (0, 1, 5, 2046, 2047, 2048, 2049, 5000, 9000)] + [None, "x y z"] * 30
    cap = Capacity()
    rows = best_fit(frame(texts), PATH).collect()
    used = check_packing(rows, cap)
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    total = 0
    for i, t in enumerate(texts):
        ids = [*want(t), 0]
        total += len(ids)
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // 2048)))
        assert [r.length for r in own][1:] == [2048] * (len(own) - 1)
        assert all(r.ids_crc32 == crc(ids[r.start : r.start + r.length]) for r in own)
        assert sum(r.length for r in own) == len(ids)
    assert used <= -(-total // 2048) + 1
    assert best_fit(empty, PATH).count() == 0


def test_packing_with_capacities_that_bind(frame):
    """Sequences of 600 tokens, three documents and a sixth of the attention: each of the three is what closes some."""
    rnd = random.Random(2)
    texts = ["word " * rnd.choice([3, 5, 40, 180, 400]) for _ in range(150)]
    for rule in ("norm", "dot"):
        cap = Capacity(600, 3, 200_000, rule=rule)
        docs = frame(texts)
        rows = best_fit(docs, PATH, cap=cap).collect()
        assert sum(r.length for r in rows) == sum(len(want(t)) + 1 for t in texts)
        used = check_packing(rows, cap)
        load = defaultdict(list)
        for r in rows:
            load[r.sequence_id].append(r.length)
        full = [(sum(v) + 6 > 600, len(v) == 3, sum(n * n for n in v) > 160_000) for v in load.values()]
        assert all(any(f[k] for f in full) for k in (1, 2))
        assert used <= one_by_one(Counter(r.length for r in rows), cap) + (0 if rule == "norm" else 6)


def one_by_one(counts, cap):
    """Places piece after piece; the plan must use as many sequences."""
    full, w = np.array([cap.tokens, cap.documents, cap.attention], float), np.array(cap.weights)
    left = np.zeros((0, 3))
    for size in sorted(counts, reverse=True):
        need = np.array([size, 1, size * size], float)
        for _ in range(counts[size]):
            fits = np.flatnonzero((left >= need).all(axis=1))
            if len(fits):
                if cap.rule == "dot":
                    score = -((left[fits] / full) * (need / full) * w).sum(axis=1)
                else:
                    score = (w * ((left[fits] - need) / full) ** 2).sum(axis=1)
                left[fits[np.argmin(score)]] -= need
            else:
                left = np.vstack([left, full - need])
    return len(left)


def test_plan_equals_one_by_one_placing():
    rnd = random.Random(5)
    for cap in (Capacity(), Capacity(100, 4, 100 * 100), Capacity(100, 50, 3000), Capacity(64, 5, 64 * 40, rule="dot")):
        counts = Counter(min(rnd.randrange(1, cap.tokens + 1), int(cap.attention**0.5), rnd.randrange(1, cap.tokens + 1)) for _ in range(400))
        made = plan(counts, cap)
        assert abs(made.sequences - one_by_one(counts, cap)) <= (0 if cap.rule == "norm" else 6)
        load = defaultdict(lambda: [0, 0, 0])
        covered = Counter()
        for size, n, seq in zip(made.size, made.count, made.sequence):
            covered[int(size)] += int(n)
            for s in range(seq, seq + n):
                load[s] = [load[s][0] + size, load[s][1] + 1, load[s][2] + size * size]
        assert covered == counts
        assert all(a <= cap.tokens and b <= cap.documents and c <= cap.attention for a, b, c in load.values())
