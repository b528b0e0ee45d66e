from __future__ import annotations

import hashlib
import re
from collections import defaultdict

from tidegate.llm.exact import content_sort, keep_first


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    return sorted((i, min(g)[1], len(g), i == min(g)[1], hashlib.sha256(n.encode()).hexdigest()) for n, g in groups.items() for _, i in g)


def test_equals_brute_force(frame):
    texts = ["a b", "ab", "a  b", None, "", " \t\n", "\x0b\x0c\r", "Ab", "a b", "é x", "éx", "z" * 50_000, "z " * 50_000, "same"] + ["same"] * 700
    got = content_sort(frame(texts, parts=5)).collect()
    assert sorted(map(tuple, got)) == brute(list(enumerate(texts)))


def test_a_run_over_many_partitions(spark, frame):
    texts = ["copy"] * 900 + ["other"] * 20
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = content_sort(frame(texts)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert sorted(map(tuple, got)) == brute(list(enumerate(texts)))


def test_a_hot_text_beside_others_of_its_beginning(spark, frame):
    """Many texts of one beginning, sorted by what follows, around a run that crosses partitions."""
    texts = [f"{'the same beginning of a text that is long ' * 2}{k % 37}" for k in range(400)] + ["the same beginning of a text that is long " * 2] * 500 + [None, "", " "]
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = content_sort(frame(texts, parts=5)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert sorted(map(tuple, got)) == brute(list(enumerate(texts)))


def test_equal_texts_are_neighbours_by_content():
    """Equality is that of the texts, whatever their digests say."""
    import pyarrow as pa
    from unittest import mock

    from tidegate.llm import exact

    rows = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3, 4], "norm": ["a", "a", "b", "b"], "sha": ["x"] * 4})
    with mock.patch("pyspark.TaskContext.get", return_value=mock.Mock(partitionId=lambda: 0)):
        got = [r for b in exact._runs([rows.slice(0, 1), rows.slice(1, 2), rows.slice(3)]) for r in b.to_pylist() if r["edge"] is None]
    assert [(r["doc_id"], r["head_id"], r["n"], r["first"]) for r in got] == [(1, 1, 2, True), (2, 1, 2, False), (3, 3, 2, True), (4, 3, 2, False)]


def test_columns_that_clash(spark):
    docs = spark.createDataFrame([(1, "a", 5, 6, 7), (2, " a", 5, 6, 7)], "doc_id long, text string, own int, nth int, kept_sha int")
    assert [tuple(r) for r in keep_first(docs).collect()] == [(2, " a", 5, 6, 7)]


def test_kept_rows(spark, frame, empty):
    docs = frame(["x y", "xy", "q", "q", None, ""])
    twice = docs.union(docs)
    assert sorted(r.doc_id for r in keep_first(docs).collect()) == [0, 2, 4]
    assert sorted(r.doc_id for r in keep_first(twice).collect()) == [0, 2, 4]
    assert keep_first(docs).columns == docs.columns
    assert content_sort(empty).count() == keep_first(empty).count() == 0
    nulls = spark.createDataFrame([(None, "t"), (1, "t"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.group_size, r.kept) for r in content_sort(nulls).collect()) == [(False, 2, False), (True, 1, True), (True, 2, True)]
