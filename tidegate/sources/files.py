"""Files as binary packets, chunked reads and writes, and WAV audio."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 8192
WAV_CHUNK = 1920


def chunked(df: DataFrame, data: Column, size: int = CHUNK, *keep: str) -> DataFrame:
    """Chunks of at most `size` bytes: chunk_no from 0, and the bytes. Empty data has no chunk."""
    if size < 1:
        raise ValueError("a chunk has at least one byte")
    rows = df.select(*keep, data.alias("__data")).where(F.octet_length("__data") > 0)
    n = F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("__data") - 1) / size).cast("int")))
    return rows.withColumn("chunk_no", n).select(*keep, "chunk_no", F.substring("__data", F.col("chunk_no") * size + 1, F.lit(size)).alias("data"))


def read_binary(spark: SparkSession, path: str, size: int = CHUNK) -> DataFrame:
    """path, chunk_no, data of every file below a path."""
    files = spark.read.format("binaryFile").load(path)
    return chunked(files, F.col("content"), size, "path")


def written_blocks(sizes: list[int], size: int = CHUNK) -> list[int]:
    """Sizes of the writes of a sink that flushes its whole buffer once it holds `size` bytes, and what is left at the end."""
    out, held = [], 0
    for n in sizes:
        held += n
        if held >= size:
            out.append(held)
            held = 0
    return out + ([held] if held else [])


def concatenated(df: DataFrame, stream: str, order: str, data: str) -> DataFrame:
    """One binary value per stream, of its packets in order; discarded counts packets without data."""
    hexed = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col(data).isNotNull(), F.struct(order, F.hex(data).alias("h"))))), lambda x: x["h"]), "")
    return df.groupBy(stream).agg(F.unhex(hexed).alias("data"), F.count_if(F.col(data).isNull()).alias("discarded"))


def write_streams(packets: DataFrame, path: str) -> DataFrame:
    """Writes the bytes of each stream, in order, below path/stream=<id>/ as numbered parts of a bounded size, and returns
    stream_id, parts, n_bytes, discarded (packets without bytes). A stream may be of any size: its parts are dealt out by
    ranges of seq, so no task and no row holds it whole."""
    spark = packets.sparkSession
    rows = packets.withColumn("data", F.when(F.col("kind") == "Binary", F.col("binary.data")))
    held = rows.where("data is not null").select(F.col("stream_id").alias("stream"), "seq", "data")
    held.repartitionByRange("stream", "seq").sortWithinPartitions("stream", "seq").write.mode("overwrite").partitionBy("stream").parquet(path)
    back = spark.read.schema("seq long, data binary, stream string").parquet(path)
    sizes = back.select("stream", F.input_file_name().alias("part"), F.octet_length("data").alias("n"))
    files = sizes.groupBy("stream", "part").agg(F.sum("n").alias("n")).groupBy("stream").agg(F.count("*").alias("parts"), F.sum("n").alias("n_bytes"))
    lost = rows.groupBy("stream_id").agg(F.count_if(F.col("data").isNull()).alias("discarded"))
    return lost.join(files, lost["stream_id"] == files["stream"], "left").select("stream_id", F.coalesce("parts", F.lit(0)).alias("parts"), F.coalesce("n_bytes", F.lit(0)).alias("n_bytes"), "discarded")


def content_type(*choices: Column) -> Column:
    """Configured, then the last node's own, then the input's, then bytes."""
    return F.coalesce(*choices, F.lit("application/octet-stream"))


def parse_wav(data: bytes) -> tuple[int, int, np.ndarray]:
    """Sample rate, channels and samples as 32-bit floats. PCM of 8, 16, 24 or 32 bits, or 32-bit float."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, form = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        body = data[at + 8 : at + 8 + size]
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", body)
            if form[0] == 0xFFFE:
                form = (struct.unpack_from("<H", body, 24)[0], *form[1:])
        elif name == b"data":
            if form is None:
                raise ValueError("samples come before their format")
            tag, channels, rate, _, _, bits = form
            body = body[: len(body) // (bits // 8) * (bits // 8)]
            if (tag, bits) == (3, 32):
                return rate, channels, np.frombuffer(body, "<f4")
            if tag != 1:
                raise ValueError(f"format {tag} with {bits} bits isn't supported")
            if bits == 8:
                return rate, channels, (np.frombuffer(body, np.uint8).astype(np.float32) - 128) / 128
            if bits == 24:
                raw = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int32)
                x = (raw[:, 0] << 8 | raw[:, 1] << 16 | raw[:, 2] << 24) >> 8
                return rate, channels, (x / float(1 << 23)).astype(np.float32)
            return rate, channels, (np.frombuffer(body, f"<i{bits // 8}") / float(1 << (bits - 1))).astype(np.float32)
        at += 8 + size + size % 2
    raise ValueError("no samples")


def make_wav(rate: int, channels: int, samples: np.ndarray) -> bytes:
    """16-bit PCM."""
    body = np.clip(np.rint(np.asarray(samples) * 32767), -32768, 32767).astype("<i2").tobytes()
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, 1, channels, rate, rate * channels * 2, channels * 2, 16, b"data", len(body))
    return head + body


def wav_frames(df: DataFrame, name: str, data: str, size: int = WAV_CHUNK) -> DataFrame:
    """Frames of at most `size` interleaved samples of each file: name, seq, sample_rate, channels, samples, error.

    A file that can't be parsed makes one row that says why."""
    schema = pa.schema([("name", pa.string()), ("seq", pa.int64()), ("sample_rate", pa.int32()), ("channels", pa.int32()), ("samples", pa.list_(pa.float32())), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rate, channels, x = parse_wav(bytes(d or b""))
                    rows = [(n, k, rate, channels, x[i : i + size].tolist(), None) for k, i in enumerate(range(0, len(x), size))]
                except ValueError as e:
                    rows = [(n, 0, None, None, None, str(e))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return df.select(F.col(name).cast("string"), data).mapInArrow(run, "name string, seq long, sample_rate int, channels int, samples array<float>, error string")
