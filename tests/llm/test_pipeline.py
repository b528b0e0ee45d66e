"""The stages one by one against plain Python, and the whole run."""

from __future__ import annotations

import importlib.util
import random

import pytest

pytestmark = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="there is no pipeline")


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    rnd = random.Random(6)
    texts = [words(rnd, 60) for _ in range(400)]
    for i in range(0, 400, 5):
        texts[i] = texts[i].replace(" ", " vile ", 3).replace(" ", " scoundrel ", 2)
    item = words(rnd, 30)
    planted = {401: texts[1] + " ", 402: " ".join(texts[2].split()[:-1]), 403: texts[3] + " " + item + " " + texts[4], 404: None, 405: "", 406: texts[6] + " " * 9}
    rows = [(i, t, "en", "src", len(t)) for i, t in enumerate(texts)] + [(i, t, "en", None, None) for i, t in planted.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{at}/documents.parquet")
    labels = [(i, 0, int(i % 5 == 0)) for i in range(400)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages(spark, tables):
    import corpus_pipeline

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tables).cache()
        assert docs.columns == columns
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    everything = {*range(400), *range(401, 407)}
    assert everything - kept["toxicity"] == {i for i in range(400) if i % 5 == 0}
    assert kept["toxicity"] - kept["exact_dedup"] == {1, 6, 405}  # the longer text stays; of the empty ones the first
    assert kept["exact_dedup"] - kept["near_dedup"] == {402}
    assert kept["near_dedup"] - kept["decontamination"] == {403}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, tables)
    assert {r.doc_id for r in packed.collect()} == kept["decontamination"]


def test_run(spark, tables):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, tables).collect()
    assert len(got) == 400 + 6 - 80 - 3 - 1 - 1
    assert sum(r.length for r in got) <= 2048 * len({r.sequence_id for r in got})
