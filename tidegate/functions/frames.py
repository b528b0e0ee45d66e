"""Audio-like frames as ARRAY<FLOAT> columns with interleaved channels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def check_gain(value: float) -> float:
    """A gain is finite and within 0 .. 4."""
    if not (0.0 <= value <= 4.0):
        raise ValueError(f"gain {value} is not within 0 .. 4")
    return float(value)


def gain(samples: Column, by: Column) -> Column:
    return F.transform(samples, lambda x: (x * by).cast("float"))


def gains(samples: Column, by: list[float]) -> Column:
    """Several gains in a row, each rounded to 32 bits as on its own."""
    def each(x: Column) -> Column:
        for g in by:
            x = (x * F.lit(g)).cast("float")
        return x

    return F.transform(samples, each)


def db_gain(db: float) -> float:
    return 10.0 ** (db / 20.0)


def num_frames(samples: Column, channels: Column) -> Column:
    return F.when(channels > 0, F.floor(F.size(samples) / channels)).otherwise(F.lit(0)).cast("long")


def duration_us(samples: Column, channels: Column, rate: Column) -> Column:
    """Null where the rate is 0."""
    return F.when(rate > 0, F.floor(num_frames(samples, channels) * 1_000_000 / rate).cast("long"))


def sum_of(samples: Column) -> Column:
    return F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double"))


def rms(samples: Column) -> Column:
    """Root of the mean square; 0 for an empty frame."""
    total = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.when(F.size(samples) > 0, F.sqrt(total / F.size(samples))).otherwise(F.lit(0.0))


def peak(samples: Column) -> Column:
    """Greatest magnitude; 0 for an empty frame."""
    return F.aggregate(samples, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x.cast("double"))))


def pad(samples: Column, size: int) -> Column:
    """Zeros up to a size."""
    short = F.greatest(F.lit(size) - F.size(samples), F.lit(0))
    return F.concat(samples, F.array_repeat(F.lit(0.0).cast("float"), short))


def mix(a: Column, b: Column) -> Column:
    """Sum of two frames; the shorter, or a missing one, counts as zeros."""
    none = F.array().cast("array<float>")
    return F.zip_with(F.coalesce(a, none), F.coalesce(b, none), lambda x, y: (F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0))).cast("float"))


def widened(samples: Column, source: Column, target: Column) -> Column:
    """Channels repeated in a cycle up to the target, which is no less than the source."""
    none = F.array().cast("array<float>")
    n = F.floor(F.size(samples) / F.greatest(source, F.lit(1))).cast("int")
    at = lambda k: F.get(samples, (F.floor(k / target) * source + (k % target) % source).cast("int"))
    more = F.when((n > 0) & (target > 0), F.transform(F.sequence(F.lit(0), n * target - 1), at)).otherwise(none)
    return F.when(source == target, samples).otherwise(more)


def convert(samples: Column, source: int, target: int) -> Column:
    """Channel conversion: mono is duplicated to two, two are averaged to mono, else channels repeat in a cycle."""
    if source == target:
        return samples
    n = F.floor(F.size(samples) / source).cast("int")
    at = lambda frame, ch: F.get(samples, (frame * source + ch).cast("int"))
    if (source, target) == (2, 1):
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: ((at(i, F.lit(0)) + at(i, F.lit(1))) / 2).cast("float"))).otherwise(F.array().cast("array<float>"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n * target - 1), lambda k: at(F.floor(k / target), (k % target) % source))).otherwise(F.array().cast("array<float>"))
