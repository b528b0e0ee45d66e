"""The built-in node kinds. All take and give packet rows (functions.packets.SCHEMA)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.functions import frames
from tidegate.functions.packets import KINDS, packets, to_tagged_json
from tidegate.functions.text import glob_any, kind_in, sanitize
from tidegate.operators import clocks, fanin, telemetry
from tidegate.operators.chunker import chunks
from tidegate.plans.registry import Registry
from tidegate.plans.types import ANY, BINARY, PASSTHROUGH, TEXT, InputPin, OutputPin, Pins, raw_audio

REGISTRY = Registry()
ONE_TO_ONE = Pins((InputPin("in"),), (OutputPin("out", PASSTHROUGH),))
SOURCE = lambda kind: Pins((), (OutputPin("out", kind),))
SINK = Pins((InputPin("in"),), ())


def _given(inputs: dict[str, DataFrame], name: str) -> DataFrame:
    if not inputs:
        raise ValueError(f"{name} needs an input table")
    return next(iter(inputs.values()))


@REGISTRY.node("io::input", SOURCE(ANY), categories=("source",))
def bound_input(inputs, config):
    """The table that a batch run is given."""
    return {"out": _given(inputs, "io::input")}


@REGISTRY.node("core::file_reader", SOURCE(BINARY), {"chunk_size": 8192}, ("path",), ("source",))
def file_reader(inputs, config):
    from pyspark.sql import SparkSession

    from tidegate.sources.files import read_binary

    got = read_binary(SparkSession.getActiveSession(), config["path"], config["chunk_size"])
    binary = F.struct(F.col("data"), F.lit(None).cast("string").alias("content_type"))
    return {"out": got.select(F.col("path").alias("stream_id"), F.col("chunk_no").cast("long").alias("seq"), F.lit("Binary").alias("kind"), binary.alias("binary"))}


@REGISTRY.node("core::passthrough", ONE_TO_ONE, categories=("core",))
def passthrough(inputs, config):
    return {"out": _given(inputs, "core::passthrough")}


@REGISTRY.node("audio::gain", Pins((InputPin("in", (raw_audio(),)),), (OutputPin("out", PASSTHROUGH),)), {"gain": 1.0, "chain": ()}, categories=("audio",))
def gain(inputs, config):
    """chain: gains that come before this one, put together by the compiler."""
    by = [frames.check_gain(g) for g in (*config["chain"], config["gain"])]
    df = _given(inputs, "audio::gain")
    louder = F.when(F.col("kind") == "Audio", F.col("audio").withField("samples", frames.gains(F.col("audio.samples"), by))).otherwise(F.col("audio"))
    return {"out": df.withColumn("audio", louder)}


@REGISTRY.node("audio::mixer", Pins((InputPin("in", (raw_audio(),), "dynamic"),), (OutputPin("out", raw_audio()),)), {"num_inputs": None, "sync_timeout_ms": 100, "clocked": False, "sample_rate": 48_000, "frame_samples_per_channel": 960, "jitter_buffer_frames": 3, "generate_silence": True}, categories=("audio",))
def mixer(inputs, config):
    """Frames of all inputs that share a tick are summed, whatever their streams; what is missing is silence.

    Synchronised: the tick is a frame's seq; nothing is mixed before every input has sent a frame (a source that never does
    is waited for without a timeout, and left out with one). Clocked: ticks of the clock's frames, of which each input has
    the newest `jitter_buffer_frames` at most, and which are silent where no input has one if generate_silence says so."""
    if config["num_inputs"] not in (None, len(inputs)):
        raise ValueError(f"audio::mixer has {len(inputs)} inputs, not {config['num_inputs']}")
    pins = [df.where("kind = 'Audio'").select(F.lit(pin).alias("pin"), "seq", "audio", "metadata") for pin, df in inputs.items()]
    both = reduce(lambda a, b: a.unionByName(b), pins)
    if config["clocked"]:
        tick = F.floor(F.col("metadata.timestamp_us") * config["sample_rate"] / (config["frame_samples_per_channel"] * 1_000_000)).cast("long")
        both = both.withColumn("tick", tick).where("tick is not null")
        both = fanin.newest(both, ["tick", "pin"], [F.col("seq").desc()], config["jitter_buffer_frames"])
        rate = F.when(F.col("audio.sample_rate") == config["sample_rate"], F.col("audio.sample_rate")).otherwise(F.raise_error(F.lit("audio::mixer: a frame's rate isn't the clock's")))
        both = both.withColumn("audio", F.col("audio").withField("sample_rate", rate.cast("int")))
        mixed = fanin.mix_frames(both, "tick")
        if config["generate_silence"]:
            mixed = fanin.with_silence(mixed, "tick", config["sample_rate"], config["frame_samples_per_channel"])
    else:
        mixed = fanin.mix_frames(fanin.warm(both.withColumn("tick", F.col("seq")), len(inputs), config["sync_timeout_ms"] is None), "tick")
    return {"out": packets(mixed, stream_id=F.lit("mix"), seq=F.col("tick"), kind=F.lit("Audio"))}


@REGISTRY.node("core::json_serialize", Pins((InputPin("in"),), (OutputPin("out", BINARY),)), {"pretty": False, "newline_delimited": False}, categories=("core",))
def json_serialize(inputs, config):
    df = _given(inputs, "core::json_serialize")
    bodies = {"Text": F.col("text"), "Audio": F.col("audio"), "Custom": F.col("custom"), "Transcription": F.col("transcription"), "Binary": F.col("binary")}
    made = F.lit(None).cast("string")
    for kind in KINDS:
        if kind.lower() in df.columns:
            made = F.when(F.col("kind") == kind, to_tagged_json(F.lit(kind), bodies[kind], config["pretty"], config["newline_delimited"])).otherwise(made)
    binary = F.struct(F.encode(made, "UTF-8").alias("data"), F.lit("application/json").alias("content_type"))
    return {"out": df.select("stream_id", "seq", F.lit("Binary").alias("kind"), binary.alias("binary"))}


@REGISTRY.node("core::text_chunker", Pins((InputPin("in", (TEXT, BINARY)),), (OutputPin("out", TEXT),)), {"split_mode": "sentences", "min_length": 10, "chunk_words": 5}, categories=("text",))
def text_chunker(inputs, config):
    # Bytes are taken as UTF-8, and invalid ones are an error; other packets are ignored.
    df = packets(_given(inputs, "core::text_chunker")).where("kind in ('Text', 'Binary')")
    df = df.withColumn("text", F.when(F.col("kind") == "Binary", F.validate_utf8(F.col("binary.data").cast("string"))).otherwise(F.col("text")))
    made = chunks(df, "stream_id", ["seq"], "text", config["split_mode"], config["min_length"], config["chunk_words"])
    return {"out": made.select("stream_id", F.col("chunk_no").alias("seq"), F.lit("Text").alias("kind"), F.col("chunk").alias("text"))}


@REGISTRY.node("text::sanitize", Pins((InputPin("in", (TEXT,)),), (OutputPin("out", TEXT),)), {"voice": "wide"}, categories=("text",))
def sanitizer(inputs, config):
    return {"out": _given(inputs, "text::sanitize").withColumn("text", sanitize(F.col("text"), config["voice"]))}


@REGISTRY.node("core::filter", ONE_TO_ONE, {"packet_types": ["Transcription", "Custom"], "event_types": []}, categories=("core",))
def packet_filter(inputs, config):
    df = _given(inputs, "core::filter")
    named = F.get_json_object("custom.data", "$.event_type") if "custom" in df.columns else F.lit(None).cast("string")
    keep = kind_in(F.col("kind"), config["packet_types"]) & ((F.col("kind") != "Custom") | glob_any(F.coalesce(named, F.lit("custom.unknown")), config["event_types"]))
    return {"out": df.where(keep)}


@REGISTRY.node("core::script", Pins((InputPin("in"),), (OutputPin("out", PASSTHROUGH),)), {}, ("process",), ("udf",))
def script(inputs, config):
    """process: a function of the packets' table that gives a Column: struct<drop: boolean, type: string, text: string>, or a
    string for texts alone. A dropped packet, or a null, goes; a result of type Text becomes a text; any other leaves the
    packet as it was."""
    df = packets(_given(inputs, "core::script"))
    made = df.withColumn("__made", config["process"](df))
    if dict(made.dtypes)["__made"] == "string":
        return {"out": packets(made.where("__made is not null"), text=F.col("__made"))}
    is_text = F.coalesce(F.col("__made.type") == "Text", F.lit(False))
    kept = made.where("__made is not null and not coalesce(__made.drop, false)")
    bodies = {c: F.when(~is_text, F.col(c)) for c in ("audio", "transcription", "custom", "binary")}
    return {"out": packets(kept, kind=F.when(is_text, F.lit("Text")).otherwise(F.col("kind")), text=F.when(is_text, F.col("__made.text")).otherwise(F.col("text")), **bodies)}


@REGISTRY.node("core::telemetry_tap", Pins((InputPin("in"),), (OutputPin("out", PASSTHROUGH), OutputPin("telemetry", ANY))), {"packet_types": ["Transcription", "Custom"], "event_type_filter": [], "audio_sample_interval_ms": 1000, "max_events_per_sec": 100}, categories=("telemetry",))
def telemetry_tap(inputs, config):
    """The packets themselves, and events about them on a second output."""
    df = packets(_given(inputs, "core::telemetry_tap"))
    events = telemetry.packet_events(df, config["packet_types"], config["event_type_filter"], tap=True)
    if "audio" in [t.lower() for t in config["packet_types"]] and config["audio_sample_interval_ms"]:
        events = events.unionByName(telemetry.audio_levels(df, 1000 * config["audio_sample_interval_ms"]))
    return {"out": df, "telemetry": telemetry.limited_events(events, config["max_events_per_sec"])}


@REGISTRY.node("core::telemetry_out", Pins((InputPin("in"),), (OutputPin("telemetry", ANY),)), {"packet_types": ["Transcription", "Custom"], "event_type_filter": [], "max_events_per_sec": 100}, categories=("telemetry", "sink"))
def telemetry_out(inputs, config):
    """The end of a pipeline: packets as events, some each second and type at most."""
    df = packets(_given(inputs, "core::telemetry_out"))
    return {"telemetry": telemetry.limited_events(telemetry.packet_events(df, config["packet_types"], config["event_type_filter"]), config["max_events_per_sec"])}


@REGISTRY.node("core::pacer", ONE_TO_ONE, {"speed": 1.0, "buffer_size": 16, "initial_burst_packets": 0, "gap_ms": 300}, categories=("core",))
def pacer(inputs, config):
    """Packets with the times at which they leave: arrivals are the timestamps, durations the packets' own."""
    if config["buffer_size"] < 1:
        raise ValueError("core::pacer: buffer_size is at least 1")
    df = packets(_given(inputs, "core::pacer"))
    paced = clocks.pace(df, "stream_id", ["seq"], F.col("metadata.timestamp_us"), F.coalesce(F.col("metadata.duration_us"), F.lit(0)), config["speed"], config["initial_burst_packets"], 1000 * config["gap_ms"])
    return {"out": packets(paced, metadata=F.col("metadata").withField("timestamp_us", F.col("release_us")))}


@REGISTRY.node("core::file_writer", Pins((InputPin("in", (BINARY,)),), (OutputPin("written", ANY),)), {"chunk_size": 8192}, ("path",), ("sink",))
def file_writer(inputs, config):
    """Each stream's bytes in order, as parts in a folder of its own below path; what comes out are the streams written, with
    their parts, bytes and discarded packets."""
    from tidegate.sources.files import write_streams

    return {"written": write_streams(packets(_given(inputs, "core::file_writer")), config["path"])}


@REGISTRY.node("core::sink", SINK, categories=("sink",))
def sink(inputs, config):
    _given(inputs, "core::sink")
    return {}


@REGISTRY.node("io::output", Pins((InputPin("in"),), (OutputPin("out", PASSTHROUGH),)), {"content_type": None}, categories=("sink",))
def bound_output(inputs, config):
    """The packets, bytes with their content type: the configured one, the packet's own, or plain bytes."""
    from tidegate.sources.files import content_type

    df = packets(_given(inputs, "io::output"))
    typed = content_type(F.lit(config["content_type"]).cast("string"), F.col("binary.content_type"))
    return {"out": df.withColumn("binary", F.when(F.col("binary").isNotNull(), F.col("binary").withField("content_type", typed)))}


@REGISTRY.node("transport::peer", Pins((InputPin("in"),), (OutputPin("out", ANY),)), categories=("transport",), bidirectional=True)
def peer(inputs, config):
    return {"out": _given(inputs, "transport::peer")}


def plugin(kind: str, process, schema: str, params: dict | None = None, registry: Registry = REGISTRY) -> None:
    """Registers a function over an iterator of pandas frames as a node; it may hold state and emit at its end."""

    def apply(inputs, config):
        return {"out": _given(inputs, kind).mapInPandas(lambda frames_: process(frames_, **config), schema)}

    registry.node(kind, ONE_TO_ONE, params or {}, categories=("plugin",))(apply)
