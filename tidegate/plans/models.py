"""Nodes around models that their users give: voice activity, speech to text, translation and text to speech.

What surrounds a model is here: windows, segments, checks of formats and languages, sentences and clean-up. A model is a
Python function over arrays or texts; it runs in batches inside tasks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.functions.each import each
from tidegate.functions.packets import packets
from tidegate.functions.text import blank, check_languages, cleaner, language_tag, translated, without_tags
from tidegate.operators import activity, ordering
from tidegate.operators.chunker import chunks
from tidegate.plans.media import audio, timing
from tidegate.plans.nodes import REGISTRY, _given
from tidegate.plans.registry import Registry
from tidegate.plans.types import TEXT, TRANSCRIPTION, InputPin, OutputPin, Pins, custom, raw_audio

RATE, WINDOW = 16_000, 512
WINDOW_MS = 1000 * WINDOW // RATE
VAD_EVENT = "plugin::native::vad/vad-event@1"


@dataclass(frozen=True)
class VadParams:
    """What a detector of voice is set to. Those that its model is built with can't change while it runs."""

    threshold: float = 0.5
    min_silence_duration_s: float = 0.5
    min_speech_duration_s: float = 0.25
    window_size: int = WINDOW
    max_speech_duration_s: float = 30.0
    output_mode: str = "events"

    def __post_init__(self) -> None:
        if not 0.0 <= self.threshold <= 1.0:
            raise ValueError(f"threshold {self.threshold} is not within 0 .. 1")
        if min(self.min_silence_duration_s, self.min_speech_duration_s) < 0 or self.max_speech_duration_s <= 0 or self.window_size < 1:
            raise ValueError("durations are 0 or more, the longest speech and the window above 0")
        if self.output_mode not in ("events", "filtered_audio"):
            raise ValueError(f"unknown output_mode '{self.output_mode}'")

    def updated(self, **changes) -> "VadParams":
        """With changes to the output mode alone; others need a new node."""
        fixed = {k for k in changes if k != "output_mode" and changes[k] != getattr(self, k)}
        if fixed:
            raise ValueError(f"{', '.join(sorted(fixed))} can't change while the node runs")
        return replace(self, **changes)


def windows(df: DataFrame) -> DataFrame:
    """Whole windows of 512 samples of each stream of 16 kHz mono audio: stream_id, window (from 0), samples. Other formats
    and other packets are an error; a last shorter window is left out."""
    checked = F.when(F.col("kind") != "Audio", F.raise_error(F.lit("only audio is taken"))).when((F.col("audio.sample_rate") != RATE) | (F.col("audio.channels") != 1), F.raise_error(F.lit("16 kHz mono audio is needed; put a resampler before"))).otherwise(F.col("audio.samples"))
    rows = packets(df).select("stream_id", "seq", checked.cast("array<float>").alias("samples"))
    cut = ordering.rechunk(rows, "stream_id", "seq", "samples", WINDOW)
    return cut.where(F.size("samples") == WINDOW).select("stream_id", F.col("chunk").alias("window"), "samples")


def probabilities(df: DataFrame, model: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Adds probability: the model's, of a matrix of windows, one row each."""

    def speech(samples: pd.Series) -> pd.Series:
        return pd.Series(np.asarray(model(np.stack(samples.to_numpy())), np.float64)) if len(samples) else pd.Series([], dtype=float)

    speech.__annotations__ = {"samples": pd.Series, "return": pd.Series}
    return df.withColumn("probability", F.pandas_udf(speech, "double")("samples"))


def vad(kind: str, model: Callable[[np.ndarray], np.ndarray], registry: Registry = REGISTRY) -> None:
    """Registers a voice-activity node: events of speech, or the speech itself."""

    def apply(inputs, config):
        params = VadParams(**{k: config[k] for k in VadParams.__dataclass_fields__})
        rows = probabilities(windows(_given(inputs, kind)), model)
        speech = F.col("probability") >= params.threshold
        if params.output_mode == "filtered_audio":
            kept = rows.where(speech)
            return {"out": packets(kept, seq=F.col("window"), kind=F.lit("Audio"), audio=audio(F.lit(RATE), F.lit(1), F.col("samples")), metadata=timing(F.col("window") * WINDOW_MS * 1000, F.lit(WINDOW_MS * 1000), F.col("window")))}
        found = activity.speech_events(rows.select("stream_id", "window", "probability"), "stream_id", ["window"], F.col("window") * WINDOW_MS, speech)
        data = F.to_json(F.struct("event_type", F.col("at_us").alias("timestamp_ms"), F.col("duration_us").alias("duration_ms")))
        event = F.struct(F.lit(VAD_EVENT).alias("type_id"), F.lit("json").alias("encoding"), data.alias("data"))
        return {"out": packets(found, seq=F.col("at_us"), kind=F.lit("Custom"), custom=event, metadata=timing(F.col("at_us") * 1000, F.lit(None), F.lit(None)))}

    defaults = {k: f.default for k, f in VadParams.__dataclass_fields__.items()}
    registry.node(kind, Pins((InputPin("in", (raw_audio(RATE, 1),)),), (OutputPin("out", custom(VAD_EVENT)),)), defaults, categories=("models",))(apply)


def segments(rows: DataFrame, silence_windows: int, longest_ms: int) -> DataFrame:
    """rows: stream_id, window, speech. stream_id, counter, start_ms, end_ms (the last speech window's end): segments that close
    after some silent windows in a row or a longest time."""
    timed = rows.select("stream_id", "window", (F.col("window") * WINDOW_MS).alias("at"), "speech")
    found = activity.segments_with_limit(timed, "stream_id", "at", "window", "speech", silence_windows, longest_ms)
    return found.select("stream_id", "counter", F.col("start_us").alias("start_ms"), (F.col("end_us") + WINDOW_MS).alias("end_ms"))


def speech_to_text(kind: str, voice: Callable[[np.ndarray], np.ndarray] | None, transcribe: Callable[[np.ndarray], str], registry: Registry = REGISTRY) -> None:
    """Registers a transcriber: speech of a segment goes to `transcribe` as one array of samples; silent windows aren't part of
    it. Without `voice`, or with use_vad false, segments are the stretches that reach max_segment_duration_secs."""

    def written(samples: pd.Series) -> pd.Series:
        return samples.map(lambda x: transcribe(np.asarray(x, np.float32)))

    written.__annotations__ = {"samples": pd.Series, "return": pd.Series}
    written = F.pandas_udf(written, "string")

    def apply(inputs, config):
        rows = windows(_given(inputs, kind))
        longest = int(1000 * config["max_segment_duration_secs"])
        if voice is not None and config["use_vad"]:
            rows = probabilities(rows, voice).withColumn("speech", F.col("probability") >= config["vad_threshold"]).drop("probability")
            found = segments(rows.select("stream_id", "window", "speech"), max(config["min_silence_duration_ms"] // WINDOW_MS, 1), longest)
            at = F.col("window") * WINDOW_MS
            # A speech window belongs to the last segment that began at or before it.
            marks = found.select("stream_id", F.floor(F.col("start_ms") / WINDOW_MS).alias("window"), F.struct("counter", "start_ms", "end_ms").alias("segment"))
            both = rows.where("speech").join(marks, ["stream_id", "window"], "left")
            both = both.withColumn("segment", F.last("segment", ignorenulls=True).over(ordering.upto(["stream_id"], ["window"]))).where(F.col("segment").isNotNull() & (at < F.col("segment.end_ms")))
        else:
            each = -(-longest // WINDOW_MS)
            k = F.floor(F.col("window") / each)
            both = rows.withColumn("segment", F.struct(k.alias("counter"), (k * each * WINDOW_MS).alias("start_ms"), ((k + 1) * each * WINDOW_MS).alias("end_ms")))
        # A segment has a longest duration, so its samples have a bound.
        parts = both.groupBy("stream_id", "segment").agg(F.sort_array(F.collect_list(F.struct("window", "samples"))).alias("parts"))
        heard = parts.select("stream_id", "segment.*", F.flatten(F.transform("parts", lambda p: p["samples"])).alias("samples"))
        heard = heard.withColumn("end_ms", F.least("end_ms", F.col("start_ms") + F.floor(F.size("samples") / RATE * 1000))) if not (voice is not None and config["use_vad"]) else heard
        told = heard.withColumn("raw", written("samples"))
        text, language = without_tags(F.col("raw")), language_tag(F.col("raw"), F.lit(config["language"]))
        told = told.withColumn("said", text).where(~blank(F.col("said")))
        one = F.struct(F.col("said").alias("text"), F.col("start_ms").alias("start_time_ms"), F.col("end_ms").alias("end_time_ms"), F.lit(None).cast("float").alias("confidence"))
        spoken = F.struct(F.col("said").alias("text"), F.array(one).alias("segments"), language.alias("language"))
        return {"out": packets(told, seq=F.col("counter"), kind=F.lit("Transcription"), transcription=spoken, metadata=timing(F.col("start_ms") * 1000, (F.col("end_ms") - F.col("start_ms")) * 1000, F.col("counter")))}

    defaults = {"use_vad": True, "vad_threshold": 0.5, "min_silence_duration_ms": 700, "max_segment_duration_secs": 30.0, "language": "auto"}
    registry.node(kind, Pins((InputPin("in", (raw_audio(RATE, 1),)),), (OutputPin("out", TRANSCRIPTION),)), defaults, categories=("models",))(apply)


def translator(kind: str, translate: Callable[[str], str], languages: tuple[str, ...] | None = None, registry: Registry = REGISTRY) -> None:
    """Registers a translator of texts and transcriptions; blank ones are skipped. languages: those that it takes, if few."""

    other = each(translate, "string")

    def apply(inputs, config):
        if languages:
            check_languages(config["source_language"], config["target_language"], config["max_length"], languages)
        rows = packets(_given(inputs, kind)).where("kind in ('Text', 'Transcription')")
        rows = rows.withColumn("text", F.when(F.col("kind") == "Text", F.col("text")).otherwise(F.col("transcription.text")))
        rows = rows.where(F.col("text").isNotNull() & ~blank(F.col("text")))
        return {"out": packets(rows, kind=F.lit("Text"), transcription=F.lit(None), text=translated(other("text")))}

    registry.node(kind, Pins((InputPin("in", (TEXT, TRANSCRIPTION)),), (OutputPin("out", TEXT),)), {"source_language": "en", "target_language": "es", "max_length": 512}, categories=("models",))(apply)


def text_to_speech(kind: str, speak: Callable[[str], np.ndarray], rate: int, voice: str = "wide", flush: bool = True, registry: Registry = REGISTRY) -> None:
    """Registers a speaker: texts of a stream are cleaned and cut into sentences, and each is spoken. flush: what is left at a
    stream's end is spoken too."""

    def spoken(text: str) -> np.ndarray:
        return np.asarray(speak(text), np.float32)

    def apply(inputs, config):
        rows = packets(_given(inputs, kind)).where("kind = 'Text'").select("stream_id", "seq", "text")
        said = chunks(rows, "stream_id", ["seq"], "text", "sentences", config["min_sentence_length"], flush=flush, clean=cleaner(voice), made=spoken, made_kind="array<float>")
        return {"out": packets(said, seq=F.col("chunk_no"), kind=F.lit("Audio"), audio=audio(F.lit(rate), F.lit(1), F.col("chunk")))}

    registry.node(kind, Pins((InputPin("in", (TEXT,)),), (OutputPin("out", raw_audio(rate, 1)),)), {"min_sentence_length": 10}, categories=("models",))(apply)


@dataclass
class Shared:
    """Things that are costly to make (models), one for each set of parameters in a worker; made when first asked for, and
    closed by `close`."""

    make: Callable[[dict], object]
    shut: Callable[[object], None] | None = None

    def __post_init__(self) -> None:
        self.held: dict[str, object] = {}

    def get(self, **params) -> object:
        key = repr(sorted(params.items()))
        if key not in self.held:
            self.held[key] = self.make(params)
        return self.held[key]

    def close(self) -> None:
        for made in self.held.values():
            if self.shut:
                self.shut(made)
        self.held.clear()
