"""The packet row: a tagged union of audio, text, transcription, custom and binary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = """
    stream_id string, seq long, kind string,
    audio struct<sample_rate: int, channels: int, samples: array<float>>,
    text string,
    transcription struct<text: string, segments: array<struct<text: string, start_time_ms: long, end_time_ms: long, confidence: float>>, language: string>,
    custom struct<type_id: string, encoding: string, data: string>,
    binary struct<data: binary, content_type: string>,
    metadata struct<timestamp_us: long, duration_us: long, sequence: long>
"""
KINDS = ("Audio", "Text", "Transcription", "Custom", "Binary")


def _filled(**fields: Column) -> list[Column]:
    from pyspark.sql.types import StructType

    return [fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(SCHEMA)]


def packets(df: DataFrame, **fields: Column) -> DataFrame:
    """Packet rows of df: named fields are set, the others kept where df has them, and null where it hasn't."""
    return df.select(*_filled(**{c: F.col(c) for c in df.columns} | fields))


def text_packets(df: DataFrame, stream: Column, seq: Column, text: Column) -> DataFrame:
    return df.select(*_filled(stream_id=stream, seq=seq, kind=F.lit("Text"), text=text))


def audio_packets(df: DataFrame, stream: Column, seq: Column, samples: Column, rate: int, channels: int = 1) -> DataFrame:
    audio = F.struct(F.lit(rate).alias("sample_rate"), F.lit(channels).alias("channels"), samples.cast("array<float>").alias("samples"))
    return df.select(*_filled(stream_id=stream, seq=seq, kind=F.lit("Audio"), audio=audio))


def custom_packets(df: DataFrame, stream: Column, seq: Column, type_id: Column, data: Column, at: Column) -> DataFrame:
    custom = F.struct(type_id.alias("type_id"), F.lit("json").alias("encoding"), data.alias("data"))
    meta = F.struct(F.unix_micros(at.cast("timestamp")).alias("timestamp_us"), F.lit(None).cast("long").alias("duration_us"), seq.cast("long").alias("sequence"))
    return df.select(*_filled(stream_id=stream, seq=seq, kind=F.lit("Custom"), custom=custom, metadata=meta))


def to_tagged_json(kind: Column, body: Column, pretty: bool = False, newline: bool = False) -> Column:
    """`{"Kind": body}`; nulls are written out. body: a struct, or a string."""
    options = {"ignoreNullFields": "false", "pretty": str(pretty).lower()}
    text = F.to_json(F.create_map(kind, body), options)
    return F.concat(text, F.lit("\n")) if newline else text
