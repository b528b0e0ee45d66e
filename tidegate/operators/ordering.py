"""Ordered building blocks: running sums, re-chunking, and folds that read each stream once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def before(stream: list[str], order: list) -> Window:
    return Window.partitionBy(*stream).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def upto(stream: list[str], order: list) -> Window:
    return Window.partitionBy(*stream).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def ordered(stream: list[str], order: list) -> Window:
    return Window.partitionBy(*stream).orderBy(*order)


def running_total(df: DataFrame, key: str, value: Column, name: str, tie: str, buckets: int = 512) -> DataFrame:
    """Sum of value over all rows up to each one in the order of (key, tie), over the whole table.

    Rows are summed by ranges of a numeric key first, so that no task holds the table: a window runs over the sums of the
    ranges (at most `buckets` rows), another inside each range."""
    low, high = df.agg(F.min(key), F.max(key)).first()
    if low is None:
        return df.withColumn(name, value)
    width = max((float(high) - float(low)) / buckets, 1e-12)
    part = F.least(F.floor((F.col(key) - F.lit(low)) / F.lit(width)), F.lit(buckets - 1)).cast("int")
    rows = df.withColumn("__v", value).withColumn("__part", part)
    sums = rows.groupBy("__part").agg(F.sum("__v").alias("__sum"))
    sums = sums.select("__part", F.coalesce(F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.sum("__v").over(upto(["__part"], [key, tie]))
    return rows.withColumn("__in", inside).join(F.broadcast(sums), "__part").withColumn(name, F.col("__before") + F.col("__in")).drop("__v", "__part", "__in", "__before")


def range_totals(df: DataFrame, stream: list[str], key: str, tie: str, values: dict[str, Column], parts: int = 256) -> DataFrame:
    """Running sums of values in each stream in the order of (key, tie), for streams that may hold most rows.

    A stream is cut into ranges of equal width of its numeric key; a window runs over the sums of the ranges, another inside
    each range, so no task holds a stream."""
    bounds = df.groupBy(*stream).agg(F.min(key).alias("__low"), F.max(key).alias("__high"))
    rows = df.select("*", *(v.cast("long").alias(f"__{n}") for n, v in values.items())).join(bounds, stream)
    width = F.greatest((F.col("__high") - F.col("__low")) / parts, F.lit(1e-12))
    rows = rows.withColumn("__part", F.least(F.floor((F.col(key) - F.col("__low")) / width), F.lit(parts - 1)).cast("int")).drop("__low", "__high")
    sums = rows.groupBy(*stream, "__part").agg(*(F.sum(f"__{n}").alias(f"__sum_{n}") for n in values))
    sums = sums.select(*stream, "__part", *(F.coalesce(F.sum(f"__sum_{n}").over(before(stream, ["__part"])), F.lit(0)).alias(f"__before_{n}") for n in values))
    inside = upto([*stream, "__part"], [key, tie])
    got = rows.select("*", *(F.sum(f"__{n}").over(inside).alias(f"__in_{n}") for n in values)).join(sums, [*stream, "__part"])
    return got.select(*df.columns, *((F.col(f"__before_{n}") + F.col(f"__in_{n}")).alias(n) for n in values))


def rechunk(df: DataFrame, stream: str, order: str, samples: str, size: int | Column) -> DataFrame:
    """All samples of a stream in order, cut into chunks of `size` (one value for each stream) and a last shorter one:
    stream, chunk, samples. Frames are cut by slices, never sample by sample; only ids and sizes are sorted by stream."""
    rows = df.withColumn("__size", F.lit(size) if isinstance(size, int) else size)
    start = F.coalesce(F.sum("__n").over(before([stream], [order])), F.lit(0))
    narrow = rows.select(stream, order, F.size(samples).alias("__n")).withColumn("__start", start).where("__n > 0")
    rows = rows.join(narrow, [stream, order])
    low, high = F.floor(F.col("__start") / F.col("__size")), F.floor((F.col("__start") + F.col("__n") - 1) / F.col("__size"))
    each = rows.withColumn("chunk", F.explode(F.sequence(low, high)))
    begin = F.greatest(F.col("chunk") * F.col("__size"), F.col("__start"))
    end = F.least((F.col("chunk") + 1) * F.col("__size"), F.col("__start") + F.col("__n"))
    part = F.slice(F.col(samples), (begin - F.col("__start") + 1).cast("int"), (end - begin).cast("int"))
    each = each.select(stream, "chunk", F.struct(begin.alias("at"), part.alias("x")).alias("__s"))
    return each.groupBy(stream, "chunk").agg(F.flatten(F.transform(F.sort_array(F.collect_list("__s")), lambda s: s["x"])).alias(samples))


#: Rows of a batch that are Python objects at once; rows, and values in them (characters, bytes, samples), of a batch that is emitted.
READ, ROWS, VALUES = 64, 1024, 1 << 20


def fold(df: DataFrame, stream: list[str], order: list[str], step: Callable, schema: str) -> DataFrame:
    """Reads each stream once, in order, across Arrow batches; a stream of any length needs the memory of its state only, and
    a batch that of a few of its rows.

    step(state, row) returns the new state and the rows to emit; state begins as None, and row is None at a stream's end."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)
    wide = [k for k, t in enumerate(kinds.types) if pa.types.is_list(t) or pa.types.is_string(t) or pa.types.is_binary(t)]

    def emitted(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds.types)], schema=kinds)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, state, any_ = None, None, False
        for b in batches:
            for at in range(0, b.num_rows, READ):
                for row in b.slice(at, READ).to_pylist():
                    key = tuple(row[c] for c in stream)
                    if key != now:
                        if any_:
                            yield from step(state, None)[1]
                        now, state, any_ = key, None, True
                    state, out = step(state, row)
                    yield from out
        if any_:
            yield from step(state, None)[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for r in made(batches):
            out.append(r)
            for k in wide:
                if r[k] is not None:
                    size += len(r[k])
            if len(out) == ROWS or size > VALUES:
                yield emitted(out)
                out, size = [], 0
        if out:
            yield emitted(out)

    return df.repartition(*stream).sortWithinPartitions(*stream, *order).mapInArrow(run, schema)


def runs(df: DataFrame, stream: list[str], order: list[str], step: Callable, schema: str) -> DataFrame:
    """Like fold, but step gets a stream's next rows as an Arrow table, column by column: step(state, table) returns the new
    state and a table to emit."""
    import numpy as np
    import pyarrow.compute as pc

    def differ(column) -> np.ndarray:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        a, b = column.slice(1), column.slice(0, len(column) - 1)
        same = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False)
        return ~(same | (a.is_null().to_numpy(zero_copy_only=False) & b.is_null().to_numpy(zero_copy_only=False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for b in batches:
            if not b.num_rows:
                continue
            table = pa.Table.from_batches([b])
            cuts = [0, *(np.flatnonzero(np.any([differ(b.column(c)) for c in stream], axis=0)) + 1).tolist(), b.num_rows]
            made = []
            for i, j in zip(cuts, cuts[1:]):
                part = table.slice(i, j - i)
                key = tuple(part.column(c)[0].as_py() for c in stream)
                if key != now:
                    now, state = key, None
                state, out = step(state, part)
                made.append(out)
            yield from pa.concat_tables(made).combine_chunks().to_batches()

    return df.repartition(*stream).sortWithinPartitions(*stream, *order).mapInArrow(run, schema)
