"""Stateful operators on unbounded inputs: event time, watermarks, and state for each key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def with_watermark(df: DataFrame, at: str, late: str) -> DataFrame:
    """Event times without a zone can't carry a watermark."""
    return df.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)


def level_windows(df: DataFrame, at: str, width: str, late: str, sample: str) -> DataFrame:
    rows = with_watermark(df, at, late)
    got = rows.groupBy(F.window(at, width).alias("w")).agg(F.sqrt(F.avg(F.col(sample) * F.col(sample))).alias("rms"), F.max(F.abs(sample)).alias("peak"), F.count("*").alias("sample_count"))
    return got.select(F.unix_micros("w.start").alias("start_us"), "rms", "peak", "sample_count")


def speech_sessions(df: DataFrame, stream: str, at: str, gap: str, late: str) -> DataFrame:
    rows = with_watermark(df, at, late)
    got = rows.groupBy(stream, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("packets"), F.min(at).alias("start"), F.max(at).alias("end"))
    return got.select(stream, F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "packets")


def mixed(a: DataFrame, b: DataFrame, seq: str, at: str, late: str, value: str) -> DataFrame:
    """Frames of the same number from two streams; one that stays alone past the watermark is mixed with silence."""
    x = with_watermark(a, at, late).select(F.col(seq).alias("x_seq"), F.col(at).alias("x_at"), F.col(value).alias("x"))
    y = with_watermark(b, at, late).select(F.col(seq).alias("y_seq"), F.col(at).alias("y_at"), F.col(value).alias("y"))
    near = (F.col("x_seq") == F.col("y_seq")) & (F.col("x_at") >= F.col("y_at") - F.expr(f"INTERVAL {late}")) & (F.col("x_at") <= F.col("y_at") + F.expr(f"INTERVAL {late}"))
    both = x.join(y, near, "full_outer")
    return both.select(F.coalesce("x_seq", "y_seq").alias(seq), (F.coalesce("x", F.lit(0.0)) + F.coalesce("y", F.lit(0.0))).alias(value))


def first_of_each(df: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    return with_watermark(df, at, late).dropDuplicatesWithinWatermark(keys)


def rate_limited(df: DataFrame, key: str, at: str, tie: str, window_us: int, most: int, idle_ms: int = 3_600_000) -> DataFrame:
    """The per-key limit of operators.telemetry; in a batch of the stream, a key's rows are taken in order of time. A key's
    state goes once it has been quiet for idle_ms of processing time."""

    def limit(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values([at, tie])
        allowed = []
        for t in rows[at]:
            if start is None or t - start >= window_us:
                start, n, ok = int(t), 1, True
            else:
                ok = n < most
                n += ok
            allowed.append(ok)
        state.update((start, n))
        state.setTimeoutDuration(idle_ms)
        yield rows.assign(allowed=allowed)[[key, at, tie, "allowed"]]

    kinds = dict(df.dtypes)
    schema = f"{key} {kinds[key]}, {at} {kinds[at]}, {tie} {kinds[tie]}, allowed boolean"
    return df.select(key, at, tie).groupBy(key).applyInPandasWithState(limit, schema, "start long, n long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def chunked_text(df: DataFrame, stream: str, seq: str, text: str, mode: str = "sentences", min_length: int = 10, words: int = 5) -> DataFrame:
    """Text chunks whose buffer outlives a batch; what a stream leaves in its buffer is emitted once it has gone quiet."""
    from tidegate.operators.chunker import Chunker

    chunker = Chunker(mode, min_length, words)

    def run(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffer, n = state.get if state.exists else ("", 0)
        out: list[str] = []
        if state.hasTimedOut:
            out = [buffer] if buffer else []
            state.remove()
        else:
            for t in pd.concat(list(frames)).sort_values(seq)[text]:
                buffer, made = chunker.feed(buffer, t or "")
                out += made
            state.update((buffer, n + len(out)))
            state.setTimeoutDuration(60_000)
        yield pd.DataFrame({stream: [keys[0]] * len(out), "chunk_no": range(n + 1, n + 1 + len(out)), "chunk": out})

    kind = dict(df.dtypes)[stream]
    return df.select(stream, seq, text).groupBy(stream).applyInPandasWithState(run, f"{stream} {kind}, chunk_no long, chunk string", "buffer string, n long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def best_effort(value: Column, capacity: int) -> Column:
    """Whether a packet finds room, by its place among the arrivals of its tick."""
    return value <= capacity
