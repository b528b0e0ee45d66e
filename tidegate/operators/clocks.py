"""Running media clocks and pacing schedules, in integer microseconds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.operators.ordering import before, ordered, upto


def div(a: Column, b: int | Column) -> Column:
    return F.floor(a / b).cast("long")


def frame_timing(df: DataFrame, stream: str, order: str, frames_in: Column, rate: int) -> DataFrame:
    """duration_us, timestamp_us (the durations before) and sequence from 0."""
    timed = df.withColumn("duration_us", div(frames_in * 1_000_000, rate))
    w = before([stream], [order])
    return timed.withColumn("timestamp_us", F.coalesce(F.sum("duration_us").over(w), F.lit(0))).withColumn("sequence", F.row_number().over(ordered([stream], [order])).cast("long") - 1)


def granule(df: DataFrame, stream: str, order: list[str], ts: Column, duration: Column) -> DataFrame:
    """48 kHz granule positions: a known timestamp sets the clock; a known duration moves it on; else 960 for each packet.

    Assignments restart a sum, so a row's clock is its last assignment and what was added since."""
    n = F.row_number().over(ordered(stream_list(stream), order)).cast("long") - 1
    rows = df.withColumn("__n", n)
    set_to = F.when(ts.isNotNull(), div(ts * 48_000, 1_000_000)).when(duration.isNull(), F.col("__n") * 960)
    rows = rows.withColumn("__set", set_to).withColumn("__add", F.when(F.col("__set").isNull(), div(duration * 48_000, 1_000_000)).otherwise(F.lit(0)))
    return _assigned(rows, stream, order, "granule").drop("__n")


def stream_list(stream: str | list[str]) -> list[str]:
    return [stream] if isinstance(stream, str) else stream


def _assigned(rows: DataFrame, stream: str, order: list[str], name: str) -> DataFrame:
    w = upto(stream_list(stream), order)
    rows = rows.withColumn("__total", F.sum("__add").over(w))
    base = F.last(F.when(F.col("__set").isNotNull(), F.struct(F.col("__set").alias("s"), F.col("__total").alias("t"))), ignorenulls=True).over(w)
    rows = rows.withColumn("__base", base)
    clock = F.coalesce(F.col("__base.s") + F.col("__total") - F.col("__base.t"), F.col("__total"))
    return rows.withColumn(name, clock).drop("__set", "__add", "__total", "__base")


def webm_clock(df: DataFrame, stream: str, order: list[str], ts: Column, duration: Column, has_metadata: Column) -> DataFrame:
    """Nanoseconds: a timestamp sets the clock; else a duration, or 20 ms, is added; a packet without metadata sets it to
    its number times 20 ms."""
    n = F.row_number().over(ordered([stream], order)).cast("long") - 1
    rows = df.withColumn("__n", n)
    set_to = F.when(~has_metadata, F.col("__n") * 20_000_000).when(ts.isNotNull(), ts * 1_000)
    rows = rows.withColumn("__set", set_to).withColumn("__add", F.when(F.col("__set").isNull(), F.coalesce(duration * 1_000, F.lit(20_000_000))).otherwise(F.lit(0)))
    return _assigned(rows, stream, order, "timestamp_ns").drop("__n")


def media_clock(df: DataFrame, stream: str, order: list[str], duration: Column, delay_ms: int, group_ms: int) -> DataFrame:
    """media_ms: the delay and all durations before, each rounded up to a millisecond, 1 at least (20 where unknown);
    keyframe: the first packet and each that starts a group."""
    ms = F.when(duration.isNull(), F.lit(20)).otherwise(F.greatest(F.ceil(duration / 1000), F.lit(1))).cast("long")
    rows = df.withColumn("__ms", ms)
    passed = F.coalesce(F.sum("__ms").over(before([stream], order)), F.lit(0))
    rows = rows.withColumn("__media", passed)
    return rows.withColumn("media_ms", F.col("__media") + delay_ms).withColumn("keyframe", F.pmod("__media", F.lit(group_ms)) == 0).drop("__ms", "__media")


def page_durations(df: DataFrame, stream: str, page_granule: str, packets: str, page: str) -> DataFrame:
    """Duration of a page's packets: 20 ms until the granule first changes, then that change shared by the packets of the
    page where it was seen, frozen for the rest of the stream."""
    w = Window.partitionBy(stream).orderBy(page)
    change = F.col(page_granule) - F.lag(page_granule).over(w)
    seen = F.when(change > 0, div(div(change * 1_000_000, 48_000), F.col(packets)))
    rows = df.withColumn("__seen", seen)
    return rows.withColumn("duration_us", F.coalesce(F.first("__seen", ignorenulls=True).over(upto([stream], [page])), F.lit(20_000))).drop("__seen")


def pace(df: DataFrame, stream: str, order: list[str], at_us: Column, duration: Column, speed: float, burst: int, gap_us: int) -> DataFrame:
    """Release times: packets leave in order, a duration (by speed) apart; the first `burst` of a segment a tenth of that.

    A segment ends where arrivals are more than gap_us apart. segment, in_segment (from 0), due_us (when a packet's place in
    the queue is reached, from the segment's first arrival) and release_us: that, but a packet without duration bypasses
    the queue and leaves on arrival."""
    if speed <= 0:
        raise ValueError("speed must be above 0")
    w = ordered([stream], order)
    rows = df.withColumn("__at", at_us)
    rows = rows.withColumn("__new", (F.coalesce(F.col("__at") - F.lag("__at").over(w), F.lit(gap_us + 1)) > gap_us).cast("int"))
    rows = rows.withColumn("segment", F.sum("__new").over(upto([stream], order)))
    inside = ordered([stream, "segment"], order)
    rows = rows.withColumn("in_segment", F.row_number().over(inside).cast("long") - 1)
    each = F.floor(duration / speed).cast("long")
    rows = rows.withColumn("__step", F.when(F.col("in_segment") < burst, F.floor(each / 10).cast("long")).otherwise(each))
    start = F.first("__at").over(inside)
    due = start + F.coalesce(F.sum("__step").over(before([stream, "segment"], order)), F.lit(0))
    rows = rows.withColumn("due_us", due)
    rows = rows.withColumn("release_us", F.when(duration == 0, F.col("__at")).otherwise(F.col("due_us")))
    return rows.drop("__at", "__new", "__step")


def fill_silence(df: DataFrame, stream: str, tick: str, value: Column) -> DataFrame:
    """One row per tick between a stream's first and last; a tick without packets is silent."""
    held = df.groupBy(stream, tick).agg(F.sum(value).alias("value"), F.count("*").alias("packets"))
    spine = held.groupBy(stream).agg(F.explode(F.sequence(F.min(tick), F.max(tick))).alias(tick))
    return spine.join(held, [stream, tick], "left").select(stream, tick, F.coalesce("value", F.lit(0.0)).alias("value"), F.coalesce("packets", F.lit(0)).alias("packets"), F.col("packets").isNull().alias("silent"))


def placed(df: DataFrame, stream: str, order: str, size: Column, *more: Column) -> DataFrame:
    """df and __start: what its stream has before each row. Only ids and sizes are sorted by stream; the rows, which may be
    large, meet their place by a join. more: columns worked out in the same window, by name."""
    narrow = df.select(stream, order, size.alias("__n"), *more)
    start = F.coalesce(F.sum("__n").over(before([stream], [order])), F.lit(0))
    return narrow.withColumn("__start", start)


def resample_frames(df: DataFrame, stream: str, order: str, samples: str, rate_in: int | Column, rate_out: int, channels: int | Column = 1) -> DataFrame:
    """Linear interpolation of interleaved frames: output k of a channel lies at k * in / out, clamped to the last sample.
    stream, order, first (k of the first output) and samples of each frame; a frame makes the outputs that fall between its
    samples and up to the next frame's first, so frames are neither taken apart nor joined with each other."""
    fixed = lambda v: F.lit(v) if isinstance(v, int) else v
    rows = df.withColumn("__in", fixed(rate_in)).withColumn("__c", fixed(channels))
    each = F.floor(F.size(samples) / F.greatest(F.col("__c"), F.lit(1))).cast("long")
    narrow = placed(rows, stream, order, each, F.slice(F.col(samples), F.lit(1), F.col("__c")).alias("__head"))
    # What comes next is sought from the end on: a frame of rows up to the end would be read anew for each row.
    back = before([stream], [F.col(order).desc()])
    narrow = narrow.withColumn("__next", F.last(F.when(F.col("__n") > 0, F.col("__head")), ignorenulls=True).over(back))
    rows = rows.join(narrow.select(stream, order, "__n", "__start", "__next"), [stream, order])
    first = F.ceil(F.col("__start") * rate_out / F.col("__in")).cast("long")
    after = F.ceil((F.col("__start") + F.col("__n")) * rate_out / F.col("__in")).cast("long")
    made = _interpolated(rate_out)(samples, "__next", "__n", "__start", first, after, "__in", "__c")
    return rows.select(stream, order, first.alias("first"), made.alias("samples"))


def _interpolated(rate_out: int):
    """The outputs of frames, frame by frame as arrays (the JVM would work out such an expression sample by sample)."""

    def each(samples, ahead, n, start, first, after, rate, channels):
        out = []
        for x, y, m, s, a, b, r, c in zip(samples, ahead, n, start, first, after, rate, channels):
            if not m > 0 or not b > a:
                out.append(np.zeros(0))
                continue
            place = np.arange(int(a), int(b)) * float(r) / rate_out - s
            i = np.floor(place).astype(np.int64)
            frame = np.asarray(x, np.float64)[: int(m) * int(c)].reshape(int(m), int(c))
            frame = np.vstack([frame, frame[-1] if y is None else np.asarray(y, np.float64)])
            out.append((frame[i] + (frame[i + 1] - frame[i]) * (place - i)[:, None]).ravel())
        return pd.Series(out, dtype=object)

    each.__annotations__ = {**dict.fromkeys(("samples", "ahead", "n", "start", "first", "after", "rate", "channels"), pd.Series), "return": pd.Series}
    return F.pandas_udf(each, "array<double>")


def resample(df: DataFrame, stream: str, order: str, samples: str, rate_in: int, rate_out: int) -> DataFrame:
    """resample_frames of mono streams, one row for each output: stream, k, value."""
    made = resample_frames(df, stream, order, samples, rate_in, rate_out).select(stream, "first", F.posexplode("samples").alias("__p", "value"))
    return made.select(stream, (F.col("first") + F.col("__p")).alias("k"), "value")
