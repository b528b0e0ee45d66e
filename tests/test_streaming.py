"""Streaming forms give what the batch forms give."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidegate.operators import telemetry
from tidegate.streaming import policies

HOUR = 3_600_000_000


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events"))
    rows = spark.range(200).select(F.col("id").alias("event_id"), (F.col("id") % 3).alias("user_id"), F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id") * 600_000_000).alias("ts"), (F.col("id") % 7).cast("double").alias("value"))
    # A last row past every window lets the watermark close them all.
    last = spark.createDataFrame([(1000, 9)], "event_id long, user_id long").select("event_id", "user_id", F.timestamp_micros(F.lit(1_704_067_200_000_000 + 900 * HOUR)).alias("ts"), F.lit(0.0).alias("value"))
    rows.coalesce(1).write.mode("append").parquet(path)
    last.coalesce(1).write.mode("append").parquet(path)
    return path


def run(spark, df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def source(spark, path, **options):
    return spark.readStream.schema("event_id long, user_id long, ts timestamp, value double").options(**options).parquet(path)


def test_level_windows(spark, events, tmp_path):
    got = run(spark, policies.level_windows(source(spark, events), "ts", "6 hours", "1 hour", "value"), "levels", tmp_path).collect()
    rows = spark.read.parquet(events).where("event_id < 1000")
    want = rows.groupBy(F.window("ts", "6 hours")).count().collect()
    assert sorted(r.sample_count for r in got) == sorted(r["count"] for r in want) and sum(r.sample_count for r in got) == 200


def test_speech_sessions(spark, events, tmp_path):
    got = run(spark, policies.speech_sessions(source(spark, events), "user_id", "ts", "1 hour", "1 hour"), "speech", tmp_path).collect()
    assert sorted((r.user_id, r.packets) for r in got if r.user_id != 9) == [(0, 67), (1, 67), (2, 66)]


def test_rate_limit(spark, events, tmp_path):
    at = lambda df: df.withColumn("at", F.unix_micros("ts"))
    stream = policies.rate_limited(at(source(spark, events, maxFilesPerTrigger=1)), "user_id", "at", "event_id", 2 * HOUR, 2)
    got = {(r.event_id, r.allowed) for r in run(spark, stream, "limits", tmp_path).collect()}
    batch = telemetry.rate_limited(at(spark.read.parquet(events)), ["user_id"], "at", "event_id", 2 * HOUR, 2)
    assert got == {(r.event_id, r.allowed) for r in batch.collect()}


def test_mixing(spark, events, tmp_path):
    a, b = source(spark, events).where("event_id % 2 = 0"), source(spark, events).where("event_id % 4 = 0")
    got = run(spark, policies.mixed(a, b, "event_id", "ts", "1 hour", "value"), "mixing", tmp_path).collect()
    values = {r.event_id: r.value for r in got}
    assert values[4] == 8.0 and values[2] == 2.0


def test_first_of_each(spark, events, tmp_path):
    twice = source(spark, events).withColumn("ts", F.col("ts"))
    got = run(spark, policies.first_of_each(twice, ["event_id"], "ts", "1 hour"), "firsts", tmp_path)
    assert got.count() == 201


def test_chunked_text(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "Hello wor"), (1, 1, "ld. More to come"), (2, 0, "Another one here. ")], "s long, seq long, text string")
    rows.coalesce(1).write.parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "t"))
    got = run(spark, policies.chunked_text(stream, "s", "seq", "text"), "chunked", tmp_path).collect()
    made = {(r.s, r.chunk_no, r.chunk) for r in got}
    # The rest of stream 1 comes once it has been quiet for a minute of processing time.
    assert made - {(1, 2, "More to come")} == {(1, 1, "Hello world."), (2, 1, "Another one here.")}
