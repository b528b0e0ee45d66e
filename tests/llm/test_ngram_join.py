from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np

from tidegate.llm import ngram_join
from tidegate.llm.components import components
from tidegate.llm.ngram_join import least_matches, linked, one_of_each, similar


def words(rnd, n):
    return ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 7))) for _ in range(n)]


def brute(texts):
    sets = []
    for t in texts:
        w = re.findall(r"\w+", (t or "").lower())
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    links, root = Counter(), list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if c and 5 * c >= 4 * (len(sets[i]) + len(sets[j]) - c):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (find(i), links[i]) for i in range(len(texts))}


def corpus():
    rnd = random.Random(9)
    texts = [None, "", "  ..", "two words", "Two  words!", "one"]
    for _ in range(12):
        base = words(rnd, rnd.randrange(30, 200))
        texts.append(" ".join(base))
        for _ in range(rnd.randrange(6)):
            own = list(base)
            for _ in range(rnd.randrange(1, 5)):
                own[rnd.randrange(len(own))] = "edited"
            texts.append(", ".join(own))
        texts.append(" ".join(base).upper())
    texts += [" ".join(words(rnd, 50)) for _ in range(60)]
    rnd.shuffle(texts)
    return texts


def test_equals_brute_force(frame, empty):
    texts = corpus()
    got = {r.doc_id: (r.class_id, r.n_links) for r in similar(frame(texts)).collect()}
    assert got == brute(texts)
    assert similar(empty).count() == 0 and one_of_each(empty).count() == 0
    kept = one_of_each(frame(texts))
    assert kept.columns == frame(texts).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for c, _ in brute(texts).values()})


def test_groups_of_many_chunks(frame, monkeypatch):
    """With chunks of 8, groups of 40 near copies are dealt out by pairs of chunks; no link may be lost or counted twice."""
    monkeypatch.setattr(ngram_join, "CHUNK", 8)
    monkeypatch.setattr(ngram_join.dealt, "__defaults__", (8,))
    rnd = random.Random(4)
    base = words(rnd, 120)
    texts = []
    for k in range(40):
        own = list(base)
        own[k * 3] = f"edit{k}"
        texts.append(" ".join(own))
    texts += [" ".join(base)] * 10 + [" ".join(words(rnd, 60)) for _ in range(10)]
    rnd.shuffle(texts)
    got = {r.doc_id: (r.class_id, r.n_links) for r in similar(frame(texts)).collect()}
    assert got == brute(texts)


def test_null_ids_and_repeated_rows(spark, frame):
    rows = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.class_id or -1, r.n_links) for r in similar(rows).collect())
    assert got == [(-1, -1, 0), (3, 3, 2), (5, 3, 2), (5, 3, 2)]
    assert sorted(r.doc_id or -1 for r in one_of_each(rows).collect()) == [-1, 3]


def shared_ids():
    """Rows that share ids but not texts: each belongs to the class of its own text."""
    rnd = random.Random(8)
    a, b, c = words(rnd, 80), words(rnd, 90), words(rnd, 70)
    near = [*b[:40], "edited", *b[41:]]
    return [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(near)), (3, " ".join(a)), (2, " ".join(c)), (2, None), (1, ""), (2, " ".join(c))]


def test_ids_that_texts_share(spark):
    rows = shared_ids()
    texts = [t for _, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    links = brute(texts)
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in similar(docs).collect())
    assert got == sorted((i, rows[links[k][0]][0], links[k][1]) for k, (i, _) in enumerate(rows))
    kept = sorted((r.doc_id, r.text or "") for r in one_of_each(docs).collect())
    assert kept == sorted((i, t or "") for i, t in [rows[0], rows[1], rows[4], rows[5], rows[6]])


def test_columns_that_clash_and_long_texts(spark):
    rnd = random.Random(3)
    long = words(rnd, 60_000)
    rows = [(1, " ".join(long), 7, 8, "x"), (2, " ".join([*long[:-1], "other"]), 7, 8, "x"), (3, "", 7, 8, "x"), (None, "a b", 7, 8, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, nth int, mark int, own string")
    assert sorted((r.doc_id or 0, r.nth, r.mark, r.own) for r in one_of_each(docs).collect()) == [(0, 7, 8, "x"), (1, 7, 8, "x"), (3, 7, 8, "x")]
    assert one_of_each(docs).columns == docs.columns


def test_only_pairs_that_survive_pruning_are_verified(monkeypatch):
    monkeypatch.setattr(ngram_join, "survivors", lambda signs, side, need: ([], []))
    verify = ngram_join._verify(4, 5)
    import pyarrow as pa

    sets = next(iter(ngram_join._sets([pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array([0, 1]), pa.array(["a b c d e f"] * 2)], names=["doc_id", "mark", "text"])])))
    batch = pa.RecordBatch.from_pylist([{"comp": b"", "lo": 0, "hi": 0, "own": 0, "members": 2, "copies": 1, "digest": d, "sign": s, "text": "a b c d e f"} for d, s in zip(sets.column(2).to_pylist(), sets.column(3).to_pylist())])
    assert [r["links"] for b in verify([batch]) for r in b.to_pylist()] == [0, 0]
    monkeypatch.undo()
    assert [r["links"] for b in verify([batch]) for r in b.to_pylist()] == [1, 1]


def test_pruning_thresholds():
    """P(similarity >= 0.8 | matches) under a uniform prior, by a plain integral."""
    x = np.linspace(0, 1, 200_001)
    for h, m in least_matches(0.8):
        for k, keeps in ((m - 1, False), (m, True)):
            if k >= 0:
                log = k * np.log(np.maximum(x, 1e-300)) + (h - k) * np.log(np.maximum(1 - x, 1e-300))
                p = np.exp(log - log.max())
                assert (p[x >= 0.8].sum() / p.sum() >= 1e-6) == keeps


def test_exact_verification():
    a = np.arange(100, dtype=np.uint64)
    every = lambda n: np.triu_indices(n, 1)
    assert [x.tolist() for x in linked([a[:80], a, a[:79], a[50:]], *every(4))] == [[0, 0], [1, 2]]
    assert [x.tolist() for x in linked([a[:80], a], *every(2))] == [[0], [1]] and linked([a[:79], a], *every(2))[0].tolist() == []
    sets = [a[k:] for k in range(30)]
    few = (np.array([0, 3]), np.array([20, 21]))
    assert ngram_join.common(sets, *few).tolist() == [80, 79]  # one by one
    assert ngram_join.common(sets, *every(30)).tolist() == [100 - j for j in every(30)[1]]
    assert [x.tolist() for x in linked(sets, *few)] == [[0, 3], [20, 21]]


def test_components(spark):
    rnd = random.Random(1)
    pairs = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(50)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.label for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: find(n) for n in root if any(n in p and p[0] != p[1] for p in pairs)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
