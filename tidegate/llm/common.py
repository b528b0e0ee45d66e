"""Helpers that the text operators share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, by its whole address: spark.checkpoint.dir, in Hadoop's default store if it
    names none. Where it isn't set, a temporary one if all runs on this machine, as in tests; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: driver and executors need a folder that they share")
        found = f"file://{tempfile.mkdtemp(prefix='tidegate-')}"
        spark.sparkContext.setCheckpointDir(found)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later jobs read these rows from the shared folder, whatever executors are lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def forget_shuffles(spark: SparkSession) -> None:
    """Has the driver collect its garbage: Spark deletes the files of a shuffle once no plan refers to it, which else may be
    long after the last job that reads it. Python's names of plans reach the JVM some time after they are gone."""
    for _ in range(2):
        gc.collect()
        time.sleep(0.5)
        spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Rows written as Parquet in the shared folder, and the folder; for rows with texts, which checkpoints don't compress."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def fresh(df: DataFrame, name: str) -> str:
    """A name like the given one that no column of df has."""
    held = {c.lower() for c in df.columns}
    while name in held:
        name += "_"
    return name


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_crc(id_col: str) -> "F.Column":
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


def slices(batches: "Iterator[pa.RecordBatch]", rows: int = 1024) -> "Iterator[pa.RecordBatch]":
    """Arrow batches in parts, so that a worker holds few texts as Python strings at a time."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def chunks(texts: list[str], budget: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most about `budget` characters each (one row at least)."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > budget:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def packed(records: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Records of each bucket, byte by byte of all of them, as most records share their high bytes, which then compress."""
    order = np.argsort(bucket, kind="stable")
    records, bucket = records[order], bucket[order]
    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else []
    for i, j in zip(cuts, np.append(cuts[1:], len(bucket)) if len(bucket) else []):
        yield int(bucket[i]), records[i:j].view(np.uint8).reshape(j - i, -1).T.tobytes()


def unpacked(parts: list[bytes], kind: np.dtype) -> np.ndarray:
    bytes_ = [np.frombuffer(p, np.uint8).reshape(kind.itemsize, -1).T for p in parts]
    return np.ascontiguousarray(np.concatenate(bytes_)).reshape(-1).view(kind) if parts else np.zeros(0, kind)
