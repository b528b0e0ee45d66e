"""Voice-activity transitions and speech segments, restated in event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.operators.ordering import fold, ordered, upto


def speech_events(df: DataFrame, stream: str, order: list[str], at_us: Column, speech: Column) -> DataFrame:
    """`speech_start` and `speech_end` rows; an end carries the time since its start. Open speech has no end."""
    rows = df.withColumn("__s", speech).withColumn("at_us", at_us)
    changed = F.coalesce(F.lag("__s").over(ordered([stream], order)), F.lit(False)) != F.col("__s")
    rows = rows.withColumn("__changed", changed).where("__changed")
    start = F.lag("at_us").over(ordered([stream], order))
    return rows.select(stream, "at_us", F.when(F.col("__s"), "speech_start").otherwise("speech_end").alias("event_type"), F.when(~F.col("__s"), F.col("at_us") - start).alias("duration_us"))


def speech_only(df: DataFrame, stream: str, order: list[str], at_us: Column, speech: Column, value: Column) -> DataFrame:
    """Runs of speech: segment, its first and last time, packets, and the sum of their values."""
    rows = df.withColumn("__s", speech).withColumn("__at", at_us).withColumn("__v", value)
    begins = F.col("__s") & ~F.coalesce(F.lag("__s").over(ordered([stream], order)), F.lit(False))
    rows = rows.withColumn("__b", begins.cast("int")).withColumn("segment", F.sum("__b").over(upto([stream], order)))
    return rows.where("__s").groupBy(stream, "segment").agg(F.min("__at").alias("start_us"), F.max("__at").alias("end_us"), F.count("*").alias("packets"), F.sum("__v").alias("value"))


def segments_by_gap(df: DataFrame, stream: str, order: list[str], at_us: Column, gap_us: int) -> DataFrame:
    """Speech packets less than gap_us apart belong together: segment (from 1), start_us, end_us, packets."""
    rows = df.withColumn("__at", at_us)
    fresh = F.coalesce(F.col("__at") - F.lag("__at").over(ordered([stream], order)) >= gap_us, F.lit(True)).cast("int")
    rows = rows.withColumn("__f", fresh).withColumn("segment", F.sum("__f").over(upto([stream], order)))
    return rows.groupBy(stream, "segment").agg(F.min("__at").alias("start_us"), F.max("__at").alias("end_us"), F.count("*").alias("packets"))


def segments_with_limit(df: DataFrame, stream: str, at: str, tie: str, speech: str, silent: int, longest_us: int) -> DataFrame:
    """Segments of speech windows that close after `silent` windows without speech in a row, or once they last longest_us;
    silent windows aren't part of a segment, and any speech window resets their count. What is open at the end is flushed.

    Rows: stream, counter (from 0), start_us, end_us, windows."""

    def step(state, row):
        counter, start, last, n, quiet = state or (0, None, None, 0, 0)
        if row is None:
            return None, [(last_stream[0], counter, start, last, n)] if start is not None else []
        last_stream[0] = row[stream]
        out = []
        if row[speech]:
            start, last, n, quiet = row[at] if start is None else start, row[at], n + 1, 0
            if row[at] - start >= longest_us:
                out, counter, start, n = [(row[stream], counter, start, last, n)], counter + 1, None, 0
        elif start is not None:
            quiet += 1
            if quiet >= silent or row[at] - start >= longest_us:
                out, counter, start, n, quiet = [(row[stream], counter, start, last, n)], counter + 1, None, 0, 0
        return (counter, start, last, n, quiet), out

    last_stream = [None]
    kind = dict(df.dtypes)[stream]
    return fold(df.select(stream, at, tie, speech), [stream], [at, tie], step, f"{stream} {kind}, counter long, start_us long, end_us long, windows long")


def level_windows(df: DataFrame, at: str, width: str, sample: str) -> DataFrame:
    """Root mean square, peak and count of the samples of each window of event time."""
    w = F.window(at, width)
    got = df.groupBy(w.alias("w")).agg(F.sqrt(F.avg(F.col(sample) * F.col(sample))).alias("rms"), F.max(F.abs(sample)).alias("peak"), F.count("*").alias("sample_count"))
    return got.select(F.unix_micros(F.col("w.start").cast("timestamp")).alias("start_us"), "rms", "peak", "sample_count")


def last_speech(df: DataFrame, stream: str, order: list[str]) -> DataFrame:
    return df.withColumn("n", F.row_number().over(Window.partitionBy(stream).orderBy(*[F.col(c).desc() for c in order]))).where("n = 1").drop("n")
