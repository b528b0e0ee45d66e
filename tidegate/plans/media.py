"""Nodes for audio rates, pacing, containers and codecs. Importing this module registers them.

Codecs themselves are given by their users: `codec` registers a function of bytes or samples as a node, with what surrounds
it here (header packets, small packets, chunks, timing)."""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.functions import filters, frames
from tidegate.functions.each import each
from tidegate.functions.packets import packets
from tidegate.operators import clocks, ordering
from tidegate.plans.nodes import REGISTRY, _given
from tidegate.plans.registry import Registry
from tidegate.plans.types import BINARY, OPUS, InputPin, OutputPin, Pins, raw_audio
from tidegate.sources import ogg, webm
from tidegate.sources.files import WAV_CHUNK, chunked, parse_wav

# Frames per channel that a resampler may emit; 0 takes what a chunk of input gives.
FRAME_SIZES = (0, 120, 240, 480, 960, 1920, 2880)
SILENCE_US = 20_000


def audio(rate: Column, channels: Column, samples: Column) -> Column:
    return F.struct(rate.cast("int").alias("sample_rate"), channels.cast("int").alias("channels"), samples.cast("array<float>").alias("samples"))


def timing(at: Column, duration: Column, sequence: Column) -> Column:
    return F.struct(at.cast("long").alias("timestamp_us"), duration.cast("long").alias("duration_us"), sequence.cast("long").alias("sequence"))


def one_format(df: DataFrame) -> DataFrame:
    """Audio packets with the rate and channels of their stream as __rate and __channels; a stream with two formats is an error."""
    kinds = df.groupBy("stream_id").agg(*(f(f"audio.{c}").alias(f"{n}_{c}") for c in ("sample_rate", "channels") for n, f in (("low", F.min), ("high", F.max))))
    one = lambda c: F.when(F.col(f"low_{c}") == F.col(f"high_{c}"), F.col(f"low_{c}")).otherwise(F.raise_error(F.lit("the format of a stream changes")).cast("int"))
    return df.join(kinds.select("stream_id", one("sample_rate").alias("__rate"), one("channels").alias("__channels")), "stream_id")


def timed_chunks(chunks: DataFrame, rate: Column, channels: Column, start: Column) -> DataFrame:
    """chunks: stream_id, chunk, samples and columns of rate, channels and start. Audio packets numbered from 0, whose times
    advance by what was emitted before them."""
    n = F.size("samples") / F.greatest(channels, F.lit(1))
    narrow = chunks.select("stream_id", "chunk", F.floor(F.floor(n) * 1_000_000 / F.greatest(rate, F.lit(1))).cast("long").alias("__d"))
    passed = F.coalesce(F.sum("__d").over(ordering.before(["stream_id"], ["chunk"])), F.lit(0))
    nth = F.row_number().over(Window.partitionBy("stream_id").orderBy("chunk")) - 1
    narrow = narrow.withColumn("__t", passed).withColumn("__k", nth)
    rows = chunks.join(narrow, ["stream_id", "chunk"])
    return packets(rows, seq=F.col("chunk"), kind=F.lit("Audio"), audio=audio(rate, channels, F.col("samples")), metadata=timing(F.coalesce(start, F.lit(0)) + F.col("__t"), F.col("__d"), F.col("__k")))


@REGISTRY.node("audio::resampler", Pins((InputPin("in", (raw_audio(),)),), (OutputPin("out", raw_audio()),)), {"output_frame_size": 960}, ("target_sample_rate", "chunk_frames"), ("audio",))
def resampler(inputs, config):
    """Linear interpolation to the target rate and frames of one size (the last is shorter); a stream that has the rate
    keeps its samples. Packets of other kinds go on as they are."""
    target, size = config["target_sample_rate"], config["output_frame_size"]
    if target <= 0 or config["chunk_frames"] <= 0:
        raise ValueError("audio::resampler: target_sample_rate and chunk_frames are above 0")
    if size not in FRAME_SIZES:
        raise ValueError(f"audio::resampler: output_frame_size {size} is none of {FRAME_SIZES}")
    df = packets(_given(inputs, "audio::resampler"))
    rows = one_format(df.where("kind = 'Audio'")).withColumn("__x", F.col("audio.samples"))
    made = clocks.resample_frames(rows, "stream_id", "seq", "__x", F.col("__rate"), target, F.col("__channels"))
    about = rows.groupBy("stream_id").agg(F.first("__rate").alias("__rate"), F.first("__channels").alias("__channels"), F.min_by("metadata.timestamp_us", "seq").alias("__at"))
    each = F.lit(size) if size else F.greatest(F.floor(config["chunk_frames"] * F.lit(target) / F.col("__rate")), F.lit(1))
    cut = ordering.rechunk(made.join(about, "stream_id").withColumn("__each", (each * F.col("__channels")).cast("long")), "stream_id", "seq", "samples", F.col("__each"))
    out = timed_chunks(cut.join(about, "stream_id"), F.lit(target), F.col("__channels"), F.col("__at"))
    return {"out": out.unionByName(df.where("kind <> 'Audio'"))}


@REGISTRY.node("audio::pacer", Pins((InputPin("in", (raw_audio(),)),), (OutputPin("out", raw_audio()),)), {"speed": 1.0, "buffer_size": 32, "generate_silence": True, "initial_sample_rate": None, "initial_channels": None, "gap_ms": 300}, categories=("audio",))
def audio_pacer(inputs, config):
    """Audio packets at the times at which they leave, and frames of 20 ms of silence for each tick between a stream's first
    and last packet in which none does. An initial format gives the silence's rate and channels, else the stream's own."""
    rate, channels = config["initial_sample_rate"], config["initial_channels"]
    if (rate is None) != (channels is None):
        raise ValueError("audio::pacer: initial_sample_rate and initial_channels are given both or neither")
    if config["buffer_size"] < 1:
        raise ValueError("audio::pacer: buffer_size is at least 1")
    df = packets(_given(inputs, "audio::pacer")).where("kind = 'Audio'")
    own = F.coalesce(F.col("metadata.duration_us"), frames.duration_us(F.col("audio.samples"), F.col("audio.channels"), F.col("audio.sample_rate")), F.lit(0))
    paced = clocks.pace(df, "stream_id", ["seq"], F.col("metadata.timestamp_us"), own, config["speed"], 0, 1000 * config["gap_ms"])
    paced = paced.withColumn("__tick", F.floor(F.col("release_us") / SILENCE_US).cast("long"))
    out = packets(paced, metadata=F.col("metadata").withField("timestamp_us", F.col("release_us")))
    if not config["generate_silence"]:
        return {"out": out}
    span = paced.groupBy("stream_id").agg(F.min("__tick").alias("a"), F.max("__tick").alias("b"), F.max_by(F.struct("audio.sample_rate", "audio.channels"), "seq").alias("f"))
    spine = span.select("stream_id", F.explode(F.sequence("a", "b")).alias("__tick"), "f")
    quiet = spine.join(paced.select("stream_id", "__tick").distinct(), ["stream_id", "__tick"], "left_anti")
    r, c = (F.col("f.sample_rate"), F.col("f.channels")) if rate is None else (F.lit(rate), F.lit(channels))
    none = F.array_repeat(F.lit(0.0).cast("float"), (F.floor(r * SILENCE_US / 1_000_000) * c).cast("int"))
    silent = packets(quiet, seq=F.lit(None).cast("long"), kind=F.lit("Audio"), audio=audio(r, c, none), metadata=timing(F.col("__tick") * SILENCE_US, F.lit(SILENCE_US), F.lit(None)))
    return {"out": out.unionByName(silent)}


class WavReader:
    """Samples of a WAV file that arrives in pieces; holds what is needed to find its format, then one chunk."""

    def __init__(self) -> None:
        self.held, self.form, self.left = b"", None, 0
        self.rest = np.zeros(0, np.float32)

    def feed(self, data: bytes, end: bool = False) -> list[np.ndarray]:
        self.held += data
        while self.form is None and (at := self._body()) is not None:
            self.held = self.held[at:]
        if self.form is None:
            return []
        whole = min(len(self.held), self.left) // self.form[3] * self.form[3]
        body, self.held = self.held[:whole], self.held[whole:]
        self.left -= whole
        head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + whole, b"WAVE", b"fmt ", 16, self.form[0], self.form[2], self.form[1], 0, 0, self.form[4], b"data", whole)
        samples = np.concatenate([self.rest, parse_wav(head + body)[2]]) if whole else self.rest
        cut = len(samples) if end else len(samples) // WAV_CHUNK * WAV_CHUNK
        self.rest = samples[cut:]
        return [samples[k : k + WAV_CHUNK] for k in range(0, cut, WAV_CHUNK)]

    def _body(self) -> int | None:
        """Reads the format; where the samples begin, once it is known (then form is set)."""
        if len(self.held) >= 12 and (self.held[:4] != b"RIFF" or self.held[8:12] != b"WAVE"):
            raise ValueError("not a RIFF/WAVE file")
        at, form = 12, None
        while at + 8 <= len(self.held):
            name, size = self.held[at : at + 4], struct.unpack_from("<I", self.held, at + 4)[0]
            if name == b"data":
                if form is None:
                    raise ValueError("samples come before their format")
                self.form, self.left = form, size
                return at + 8
            if name == b"fmt " and len(self.held) >= at + 8 + size:
                tag, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", self.held, at + 8)
                if tag == 0xFFFE:
                    tag = struct.unpack_from("<H", self.held, at + 8 + 24)[0]
                form = (tag, rate, channels, bits // 8, bits)
            at += 8 + size + size % 2
        return None


_OUT = "stream_id string, seq long, {} , timestamp_us long, duration_us long"


def _bytes(df: DataFrame) -> DataFrame:
    return packets(df).where("kind = 'Binary'").select("stream_id", "seq", F.col("binary.data").alias("data"))


@REGISTRY.node("containers::wav::demuxer", Pins((InputPin("in", (BINARY,)),), (OutputPin("out", raw_audio()),)), categories=("containers",))
def wav_demuxer(inputs, config):
    """Audio of WAV files that arrive as bytes in order, in frames of 1920 interleaved samples."""

    def step(state, row):
        reader, n, stream = state or (WavReader(), 0, None)
        made = reader.feed(b"", end=True) if row is None else reader.feed(bytes(row["data"] or b""))
        stream = stream if row is None else row["stream_id"]
        out = [(stream, n + k, *reader.form[1:3], x.tolist()) for k, x in enumerate(made)]
        return (reader, n + len(made), stream), out

    got = ordering.fold(_bytes(_given(inputs, "containers::wav::demuxer")), ["stream_id"], ["seq"], step, "stream_id string, seq long, rate int, channels int, samples array<float>")
    return {"out": packets(got, kind=F.lit("Audio"), audio=audio(F.col("rate"), F.col("channels"), F.col("samples")))}


@REGISTRY.node("containers::ogg::demuxer", Pins((InputPin("in", (BINARY,)),), (OutputPin("out", OPUS),)), categories=("containers",))
def ogg_demuxer(inputs, config):
    """Packets of an Ogg stream that arrives as bytes in order, timed by the granule positions of their pages: 20 ms each,
    until a page's granule first differs from the last one's; then what that difference gives for each packet of the page."""

    def step(state, row):
        reader, n, last, at, each = state or (ogg.PageReader(), 0, None, 0, None)
        out = []
        for data, granule in reader.feed(bytes(row["data"] or b"")) if row else ():
            n += 1
            known = granule > 0
            if known:
                if each is None and last is not None and granule > last and at:
                    each = (granule - last) * 1_000_000 // 48_000 // at
                at, last = (at + 1, last) if granule == last else (1, granule)
            out.append((row["stream_id"], n, data, granule * 1_000_000 // 48_000 if known else None, (20_000 if each is None else each) if known else None))
        return (reader, n, last, at, each), out

    got = ordering.fold(_bytes(_given(inputs, "containers::ogg::demuxer")), ["stream_id"], ["seq"], step, _OUT.format("data binary"))
    binary = F.struct(F.col("data"), F.lit(None).cast("string").alias("content_type"))
    timed = F.when(F.col("timestamp_us").isNotNull(), timing(F.col("timestamp_us"), F.col("duration_us"), F.col("seq")))
    return {"out": packets(got, kind=F.lit("Binary"), binary=binary, metadata=timed)}


@REGISTRY.node("containers::ogg::muxer", Pins((InputPin("in", (OPUS, BINARY)),), (OutputPin("out", BINARY),)), {"stream_serial": 0, "codec": "opus", "channels": 1}, categories=("containers",))
def ogg_muxer(inputs, config):
    """Pages of a stream's packets, one packet each, after two header pages; an empty page ends the stream."""
    serial, channels = config["stream_serial"], config["channels"]
    rows = packets(_given(inputs, "containers::ogg::muxer")).where("kind = 'Binary'")
    rows = clocks.granule(rows, "stream_id", ["seq"], F.col("metadata.timestamp_us"), F.col("metadata.duration_us"))

    def step(state, row):
        page, last, stream = state or (0, 0, None)
        out = []
        if page == 0 and row is not None:
            heads, page = zip(*(ogg.pages(p, serial, k, 0, ogg.BEGINS if k == 0 else 0) for k, p in enumerate(ogg.head_packets(48_000, channels)))), 2
            out.append((row["stream_id"], 0, b"".join(next(heads))))
        if row is None:
            return None, [(stream, page, ogg.pages(b"", serial, page, last, ogg.ENDS)[0])] if stream is not None else []
        data, number = ogg.pages(bytes(row["data"]), serial, page, row["granule"])
        return (number, row["granule"], row["stream_id"]), [*out, (row["stream_id"], page, data)]

    got = ordering.fold(rows.select("stream_id", "seq", F.col("binary.data").alias("data"), "granule"), ["stream_id"], ["seq"], step, "stream_id string, seq long, data binary")
    return {"out": packets(got, kind=F.lit("Binary"), binary=F.struct(F.col("data"), F.lit("audio/ogg").alias("content_type")))}


def http_get(url: str, timeout: float = 5.0) -> tuple[bytes, str | None]:
    """A body and its content type; redirects aren't followed, and any status but 2xx is an error."""
    import urllib.error
    import urllib.request

    class Stay(urllib.request.HTTPRedirectHandler):
        def redirect_request(self, *args, **kwargs):
            return None

    try:
        with urllib.request.build_opener(Stay).open(url, timeout=timeout) as got:
            return got.read(), got.headers.get("Content-Type")
    except urllib.error.HTTPError as e:
        raise ValueError(f"{url}: status {e.code}") from None


@REGISTRY.node("transport::http::fetcher", Pins((), (OutputPin("out", BINARY),)), {"chunk_size": 8192}, ("url",), ("transport",))
def fetcher(inputs, config):
    """The body of a URL, or of each of a list, in chunks of one size and a remainder. A body is read whole by one task."""
    from pyspark.sql import SparkSession

    if config["chunk_size"] < 1:
        raise ValueError("transport::http::fetcher: chunk_size is at least 1")
    urls = [config["url"]] if isinstance(config["url"], str) else list(config["url"])
    spark = SparkSession.getActiveSession()

    def fetched(frames_):
        for pdf in frames_:
            got = [http_get(u) for u in pdf["stream_id"]]
            yield pdf.assign(body=[b for b, _ in got], content_type=[t for _, t in got])

    listed = spark.createDataFrame([(u,) for u in urls], "stream_id string").repartition(max(len(urls), 1))
    bodies = listed.mapInPandas(fetched, "stream_id string, body binary, content_type string")
    cut = chunked(bodies, F.col("body"), config["chunk_size"], "stream_id", "content_type")
    return {"out": packets(cut, seq=F.col("chunk_no"), kind=F.lit("Binary"), binary=F.struct("data", "content_type"))}


@REGISTRY.node("containers::webm::muxer", Pins((InputPin("in", (OPUS, BINARY)),), (OutputPin("out", BINARY),)), {"channels": 1, "sample_rate": 48_000, "streaming_mode": "live"}, categories=("containers",))
def webm_muxer(inputs, config):
    """Clusters of one packet each, after a head that comes with the first; `file` gives a stream's parts as one packet, which
    holds a whole stream, and `live` each as it is made."""
    if config["channels"] not in (1, 2):
        raise ValueError("containers::webm::muxer: channels are 1 or 2")
    if config["streaming_mode"] not in ("live", "file"):
        raise ValueError("containers::webm::muxer: streaming_mode is live or file")
    rows = packets(_given(inputs, "containers::webm::muxer")).where("kind = 'Binary'")
    timed = clocks.webm_clock(rows, "stream_id", ["seq"], F.col("metadata.timestamp_us"), F.col("metadata.duration_us"), F.col("metadata").isNotNull())
    head = webm.head(config["sample_rate"], config["channels"])

    def blocks(at: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([webm.cluster(int(t) // 1_000_000, bytes(d)) for t, d in zip(at, data)])

    blocks.__annotations__ = {"at": pd.Series, "data": pd.Series, "return": pd.Series}
    made = timed.select("stream_id", "seq", F.pandas_udf(blocks, "binary")("timestamp_ns", "binary.data").alias("data"))
    first = F.row_number().over(Window.partitionBy("stream_id").orderBy("seq")) == 1
    made = made.withColumn("data", F.when(first, F.concat(F.lit(head), F.col("data"))).otherwise(F.col("data")))
    if config["streaming_mode"] == "file":
        parts = made.groupBy("stream_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "data"))), lambda p: p["data"]).alias("parts"))
        made = parts.select("stream_id", F.lit(0).cast("long").alias("seq"), F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p)).alias("data"))
    return {"out": packets(made, kind=F.lit("Binary"), binary=F.struct("data", F.lit('audio/webm; codecs="opus"').alias("content_type")))}


def codec(kind: str, decode: Callable[[bytes], np.ndarray], rate: int, channels: int, whole: bool = False, timed: bool = True, registry: Registry = REGISTRY) -> None:
    """Registers a decoder: a function of bytes that gives interleaved samples.

    whole: it takes a stream's bytes at once (a file), and its samples are cut into frames of 1920; else it takes packets one
    by one, header packets and those too small to hold a frame are skipped, and each makes a frame. timed: frames carry times."""

    decoded = each(lambda d: np.asarray(decode(bytes(d)), np.float32), "array<float>")

    def apply(inputs, config):
        rows = _bytes(_given(inputs, kind)).where("data is not null")
        if whole:
            # A file's bytes are one value: what is decoded at once can't be cut.
            parts = rows.groupBy("stream_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "data"))), lambda p: p["data"]).alias("parts"))
            rows = parts.select("stream_id", F.lit(0).cast("long").alias("seq"), F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p)).alias("data"))
        else:
            rows = rows.where(filters.audio_packet(F.col("data")))
        rows = rows.withColumn("samples", decoded("data"))
        cut = ordering.rechunk(rows, "stream_id", "seq", "samples", WAV_CHUNK) if whole else rows.select("stream_id", F.col("seq").alias("chunk"), "samples")
        out = timed_chunks(cut, F.lit(rate), F.lit(channels), F.lit(0))
        return {"out": out if timed else packets(out, metadata=F.lit(None))}

    registry.node(kind, Pins((InputPin("in", (BINARY, OPUS)),), (OutputPin("out", raw_audio(rate, channels)),)), {}, categories=("codecs",))(apply)


def encoder(kind: str, encode: Callable[[np.ndarray], bytes], frame_size: int = 960, registry: Registry = REGISTRY) -> None:
    """Registers an encoder of frames: short ones are padded with silence to frame_size samples for each channel, and every
    packet has the duration of a frame."""

    def encoded(samples: pd.Series) -> pd.Series:
        return samples.map(lambda x: encode(np.asarray(x, np.float32)))

    encoded.__annotations__ = {"samples": pd.Series, "return": pd.Series}
    encoded = F.pandas_udf(encoded, "binary")

    def apply(inputs, config):
        rows = packets(_given(inputs, kind)).where("kind = 'Audio'")
        full = F.col("audio.channels") * frame_size
        short = F.greatest(full - F.size("audio.samples"), F.lit(0)).cast("int")
        padded = F.concat(F.col("audio.samples"), F.array_repeat(F.lit(0.0).cast("float"), short))
        duration = F.floor(F.lit(frame_size) * 1_000_000 / F.col("audio.sample_rate"))
        binary = F.struct(encoded(padded).alias("data"), F.lit(None).cast("string").alias("content_type"))
        out = packets(rows, kind=F.lit("Binary"), audio=F.lit(None), binary=binary, metadata=timing(F.col("metadata.timestamp_us"), duration, F.col("metadata.sequence")))
        return {"out": out}

    registry.node(kind, Pins((InputPin("in", (raw_audio(),)),), (OutputPin("out", OPUS),)), {}, categories=("codecs",))(apply)


