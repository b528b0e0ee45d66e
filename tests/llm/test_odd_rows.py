"""Null ids, null, empty, repeated and very long texts, clashing columns and empty tables, in every operator."""

from __future__ import annotations

import random

import public_tokenizers
import pytest

from tidegate.llm import common
from tidegate.llm.bpe import vocabulary
from tidegate.llm.counts import edited_counts
from tidegate.llm.decontam import clean, contaminated
from tidegate.llm.exact import content_sort, keep_first
from tidegate.llm.langid import learn_and_identify
from tidegate.llm.ngram_join import one_of_each, similar
from tidegate.llm.packing import best_fit
from tidegate.llm.secretscan import find_secrets
from tidegate.llm.substring import passages
from tidegate.llm.tokenbin import round_trip
from tidegate.llm.toxicity import learn_and_score, ordinary

VOCABULARY, TIKTOKEN, PATTERN = vocabulary(), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
#: Columns that operators use themselves, and those of documents.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, digest string, rank int, own int, mark int, rare int, a int, b int, key int, n int, sha string, n_ int, size int, records string, word string"


@pytest.fixture(scope="module")
def odd(spark):
    rnd = random.Random(4)
    long = " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 8))) for _ in range(150_000))
    texts = [(1, "some plain words of a text"), (1, "some plain words of a text"), (1, "other words under the same id here"), (None, "some plain words of a text"), (None, None), (2, None), (2, ""), (3, " \t\n"), (4, long), (5, long[:700_000]), (6, "x" * 300_000), (7, "-" * 300_000), (8, "é日本😀 " * 20), (9, "\u0000\u2028 \x1f")]
    rows = [(i, t, "en" if (i or 0) % 2 else None, None, None, 1, "d", 2, 3, 4, 5, 6, 7, 8, 9, "s", 10, 11, "r", "w") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (4, 0), (8, 0), (8, 1), (None, 1), (5, None)], "doc_id long, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "some plain words of a text"), (2, None), (3, ""), (None, "x y z"), (4, "six words that are not there")], "item_id long, text string")


ONE_EACH = {
    "langid": lambda d, lab, it: learn_and_identify(d),
    "similar": lambda d, lab, it: similar(d),
    "content_sort": lambda d, lab, it: content_sort(d),
    "toxicity": lambda d, lab, it: learn_and_score(d, lab),
    "secrets": lambda d, lab, it: find_secrets(d, TIKTOKEN, PATTERN),
    "counts": lambda d, lab, it: edited_counts(d, VOCABULARY, PATTERN),
    "shards": lambda d, lab, it: round_trip(d, VOCABULARY),
}
KEEP = {"keep_first": lambda d, lab, it: keep_first(d), "one_of_each": lambda d, lab, it: one_of_each(d), "ordinary": lambda d, lab, it: ordinary(d, lab), "clean": lambda d, lab, it: clean(d, it), "clean, shuffled": lambda d, lab, it: clean(d, it, block=1)}
OTHERS = {"passages": lambda d, lab, it: passages(d), "packing": lambda d, lab, it: best_fit(d, VOCABULARY), "leaks": lambda d, lab, it: contaminated(d, it), "leaks, shuffled": lambda d, lab, it: contaminated(d, it, block=1)}
ids = lambda df: sorted(-1 if r[0] is None else r[0] for r in df.select("doc_id").collect())


@pytest.mark.parametrize("name", ONE_EACH)
def test_a_row_for_each(odd, labels, items, name):
    assert ids(ONE_EACH[name](odd, labels, items)) == ids(odd)
    assert ONE_EACH[name](odd.limit(0), labels, items).count() == 0


@pytest.mark.parametrize("name", KEEP)
def test_rows_that_stay(odd, labels, items, name):
    kept = KEEP[name](odd, labels, items)
    assert kept.columns == odd.columns
    got = ids(kept)
    assert set(got) <= set(ids(odd)) and {4, 6, 7, 8} <= set(got)
    assert all(r.n == 9 and r.mark == 4 and r.word == "w" for r in kept.select("n", "mark", "word").collect())
    assert KEEP[name](odd.limit(0), labels, items).count() == 0


@pytest.mark.parametrize("name", OTHERS)
def test_other_results(odd, labels, items, name):
    got = OTHERS[name](odd, labels, items).collect()
    if name == "packing":
        assert sorted({-1 if r.doc_id is None else r.doc_id for r in got}) == sorted(set(ids(odd)))
    elif name == "passages":
        assert {(r.doc_id, r.other_id) for r in got} == {(5, 4)} and max(r.end_word - r.start_word for r in got) > 50_000
    else:
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.item_id) for r in got) == [(-1, 1), (1, 1), (1, 1)]
    assert OTHERS[name](odd.limit(0), labels, items).count() == 0


def test_a_cluster_needs_a_shared_folder(spark):
    from unittest import mock

    far = mock.Mock()
    far.conf.get.return_value = None
    far.sparkContext.getCheckpointDir.return_value = None
    far.sparkContext.master = "spark://somewhere:7077"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(far)
    assert common.shared_dir(spark).startswith("file:/")
