"""Rows and sizes on which queries once differed from their SQL or grew faster than their input."""

from __future__ import annotations

import datetime as dt

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__
from tidegate.functions import each, text
from tidegate.operators import ordering


def same_as_sql(spark, tmp_path, name, **tables):
    """The query's rows over small tables, held against its SQL."""
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t, df in tables.items():
        df.to_parquet(tmp_path / f"{t}.parquet", index=False)
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path / t}.parquet'")
    want = con.sql(__spark_entry__.oracle_sql()[name])
    got = __spark_entry__.queries()[name](spark, str(tmp_path)).select(*want.columns)
    got, want = ([tuple(r) for r in rows] for rows in (got.collect(), want.fetchall()))
    assert len(got) == len(want) > 0
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_events_without_duration_keep_their_place_in_a_schedule(spark, tmp_path):
    values = [5.0, 0.0, 7.25, 0.0, 0.0125, 3.0, 0.0005, 2.0, 0.0135]
    ts = pd.Series([dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * i) for i in range(len(values))]).astype("datetime64[us]")
    events = pd.DataFrame({"event_id": range(len(values)), "ts": ts, "user_id": 1, "event_type": "view", "value": values, "props": "{}"})
    for name in ("pacer_schedule", "pacer_node", "moq_clock"):
        same_as_sql(spark, tmp_path, name, events=events)


class Held:
    """A table whose rows go through a fold right here."""

    def __init__(self, spark):
        self.sparkSession = spark

    def repartition(self, *_):
        return self

    sortWithinPartitions = repartition

    def mapInArrow(self, run, _):
        return run


def test_a_fold_emits_a_batch_in_parts(spark):
    step = lambda state, row: (state, [(row["k"], "x" * row["n"])] * 10) if row else (None, [])
    run = ordering.fold(Held(spark), ["k"], ["n"], step, "k long, made string")
    for n in (1, 50_000):
        batch = pa.RecordBatch.from_pydict({"k": list(range(500)), "n": [n] * 500})
        parts = [p.num_rows for p in run(iter([batch]))]
        assert sum(parts) == 5_000 and max(parts) <= min(ordering.ROWS, ordering.VALUES // n + 1)


def test_texts_are_cleaned_cut_and_spoken_in_one_pass(spark, tmp_path):
    texts = ["One two three four. Five\n\nsix   seven!\tEight — nine ten 十一。十二 thirteen", "", None, " \n ", "…", "Ünïcödé ¿qué tal? ¡Sí!", "𝒳 no end here, but a long rest", "Short. A. B. C. Enough of it? Yes!"]
    docs = pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "lang": "en", "source": "x", "n_chars": 1})
    for name in ("matcha_node", "kokoro_node", "piper_node"):
        same_as_sql(spark, tmp_path, name, documents=docs)
        plan = __spark_entry__.queries()[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan and "regexp_replace" not in plan
    for kind in ("wide", "cjk", "ascii"):
        rows = spark.createDataFrame([(t,) for t in texts if t is not None], "t string")
        want = [r[0] for r in rows.select(text.sanitize(F.col("t"), kind)).collect()]
        assert [text.cleaner(kind)(t) for t in texts if t is not None] == want


def test_values_leave_python_in_parts():
    run = each.parts(lambda d: np.zeros(len(d) * 100, np.float32), pa.list_(pa.float32()))
    values = [b"x" * 1000] * 100 + [None, b""]
    made = list(run(iter([pa.array(values)])))
    assert [None if x is None else len(x) for p in made for x in p.to_pylist()] == [100_000] * 100 + [None, 0]
    assert max(len(p) for p in made) <= 12


def test_each_translator_runs_once(spark, tmp_path):
    turns = pd.DataFrame({"conv_id": 1, "turn": range(300), "role": "user", "text": [("a" * (i % 7) + " ") * (i % 5) for i in range(300)]})
    same_as_sql(spark, tmp_path, "translator_nodes", conversations=turns)
    plan = __spark_entry__.queries()["translator_nodes"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2  # a worker for each


def test_what_follows_a_frame_is_found_without_reading_on(spark, tmp_path):
    frames = [[0.0, 1.0], [], [], [3.0], [2.0, 5.0, 4.0], []]
    e = pd.DataFrame({"vec_id": range(6), "embedding": [np.array(f, np.float32) for f in frames], "label": np.zeros(6, np.int32)})
    same_as_sql(spark, tmp_path, "resample_linear", embeddings=e)
    plan = __spark_entry__.queries()["resample_linear"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedfollowing" not in plan  # such a frame is read anew for each row
