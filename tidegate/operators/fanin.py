"""Fan-in: mixing frames that are aligned by number, with silence for what is missing, and its channel rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.functions import frames
from tidegate.operators.ordering import upto


def numbered(df: DataFrame, stream: str, order: str) -> DataFrame:
    """Adds n, a frame's number in its stream from 0."""
    return df.withColumn("n", F.row_number().over(Window.partitionBy(stream).orderBy(order)) - 1)


def mix_two(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, b: n, samples. Frames of the same number are summed; a missing one is silence."""
    left, right = a.select("n", F.col("samples").alias("x")), b.select("n", F.col("samples").alias("y"))
    return left.join(right, "n", "full_outer").select("n", frames.mix(F.col("x"), F.col("y")).alias("samples"))


def mix_many(df: DataFrame, tick: str = "n") -> DataFrame:
    """df: n, samples of any number of inputs. One row per tick and sample: n, pos, value. Sums are partial before the
    shuffle, so the inputs of a tick never meet in one list."""
    each = df.select(tick, F.posexplode("samples").alias("pos", "x"))
    return each.groupBy(tick, "pos").agg(F.sum(F.col("x").cast("double")).alias("value"))


def sticky_channels(df: DataFrame, stream: str, order: list[str], channels: str) -> DataFrame:
    """Output channels: the most that the stream has had so far."""
    return df.withColumn("sticky", F.max(channels).over(upto([stream], order)))


def newest(df: DataFrame, keys: list[str], order: list[Column], depth: int) -> DataFrame:
    """A ring that overwrites its oldest: of each key, the last `depth` rows stay."""
    return df.withColumn("__age", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__age") <= depth).drop("__age")


def clocked(df: DataFrame, tick: str, pins: list, depth: int, order: list[Column], value: Column) -> DataFrame:
    """Ticks of a clock that mix the newest `depth` frames of each pin and are silent where there are none."""
    span = df.agg(F.min(tick).alias("a"), F.max(tick).alias("b")).where("a is not null")
    spine = span.select(F.explode(F.sequence("a", "b")).alias(tick))
    held = newest(df.where(F.col("pin").isin(pins)), [tick, "pin"], order, depth).groupBy(tick).agg(F.sum(value).alias("mixed"), F.countDistinct("pin").alias("pins"))
    return spine.join(held, tick, "left").select(tick, F.coalesce("mixed", F.lit(0.0)).alias("mixed"), F.coalesce("pins", F.lit(0)).alias("pins"))


def drop_newest(df: DataFrame, keys: list[str], order: list[str], capacity: int) -> DataFrame:
    """A full channel that drops what arrives: of each key, the first `capacity` rows are delivered."""
    return df.withColumn("delivered", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) <= capacity)


def warm(df: DataFrame, inputs: int, forever: bool) -> DataFrame:
    """df: pin, tick, audio. Nothing is mixed until every input has sent a frame; of what an input sent before, its latest
    frame waits for that moment. forever: an input that never sends is waited for; else it is left out."""
    first = df.groupBy("pin").agg(F.min("tick").alias("first"))  # a row for each input
    begin = first.agg(F.max("first").alias("begin"), F.count("*").alias("seen"))
    if forever:
        begin = begin.where(F.col("seen") == inputs)
    rows = df.join(F.broadcast(begin.where("begin is not null").select("begin")))  # one row
    early = rows.where("tick <= begin")
    latest = early.groupBy("pin").agg(F.max_by(F.struct(*df.columns), "tick").alias("r"), F.first("begin").alias("begin")).select("r.*", "begin")
    return latest.withColumn("tick", F.col("begin")).unionByName(rows.where("tick > begin")).drop("begin")


def mix_frames(df: DataFrame, tick: str) -> DataFrame:
    """df: tick and audio of any inputs. One audio frame for each tick, of the most channels that there were up to it; frames
    of fewer channels are widened first, frames of different rates are an error. The inputs of a tick never meet in one list:
    samples are summed by place, with partial sums before the shuffle."""
    widest = df.groupBy(F.col("audio.channels").alias("channels")).agg(F.min(tick).alias("since"))  # a row for each number of channels
    widths = widest.agg(F.collect_list(F.struct("since", "channels")).alias("widths"))  # one row
    rows = df.select(F.col(tick).alias("tick"), "audio").join(F.broadcast(widths))
    target = F.aggregate("widths", F.lit(0), lambda m, w: F.when(w["since"] <= F.col("tick"), F.greatest(m, w["channels"])).otherwise(m))
    rows = rows.withColumn("target", target)
    wide = rows.select("tick", "target", F.col("audio.sample_rate").alias("rate"), frames.widened(F.col("audio.samples"), F.col("audio.channels"), F.col("target")).alias("x"))
    shape = wide.groupBy("tick").agg(F.first("target").alias("channels"), F.min("rate").alias("low"), F.max("rate").alias("high"))
    rate = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.raise_error(F.lit("frames of different rates can't be mixed")).cast("int"))
    each = wide.select("tick", F.posexplode("x").alias("pos", "v")).groupBy("tick", "pos").agg(F.sum(F.col("v").cast("double")).alias("v"))
    samples = each.groupBy("tick").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"].cast("float")).alias("samples"))
    made = shape.join(samples, "tick", "left")
    return made.select(F.col("tick").alias(tick), F.struct(rate.alias("sample_rate"), "channels", F.coalesce("samples", F.array().cast("array<float>")).alias("samples")).alias("audio"))


def with_silence(mixed: DataFrame, tick: str, rate: int, frames_each: int) -> DataFrame:
    """A silent frame for each tick between the first and the last that has none."""
    span = mixed.agg(F.min(tick).alias("a"), F.max(tick).alias("b"), F.max("audio.channels").alias("channels")).where("a is not null")
    spine = span.select(F.explode(F.sequence("a", "b")).alias(tick), F.col("channels").alias("__c"))
    none = F.struct(F.lit(rate).alias("sample_rate"), F.col("__c").alias("channels"), F.array_repeat(F.lit(0.0).cast("float"), F.col("__c") * frames_each).alias("samples"))
    return spine.join(mixed, tick, "left").select(tick, F.coalesce("audio", none).alias("audio"))


def slow_inputs(df: DataFrame, inputs: list[str]) -> DataFrame:
    """df: pin, tick. Changes of inputs that a mixer's timeout marks as slow and that recover: pin, tick, change. An input
    that has sent before is slow from the first tick without a frame of its own to the next with one."""
    ticks = df.select("tick").distinct()
    held = df.select("pin", "tick").distinct().withColumn("here", F.lit(True))
    every = ticks.select("tick", F.explode(F.array(*map(F.lit, inputs))).alias("pin"))
    first = held.groupBy("pin").agg(F.min("tick").alias("first"))  # a row for each input
    marked = every.join(held, ["pin", "tick"], "left").join(F.broadcast(first), "pin").where("tick >= first").withColumn("here", F.coalesce("here", F.lit(False)))
    before = F.lag("here").over(Window.partitionBy("pin").orderBy("tick"))
    changes = marked.withColumn("before", before).where("here <> before")
    return changes.select("pin", "tick", F.when(F.col("here"), "recovered").otherwise("slow").alias("change"))
