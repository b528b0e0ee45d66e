"""Queries that name nodes as a pipeline does: each compiles a pipeline and reads what comes out of it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidegate.catalogue.common import Catalogue, micros, r6, table
from tidegate.catalogue.events import PACED
from tidegate.catalogue.frames import EACH, packets as frame_packets
from tidegate.catalogue.text import _cuts, _sanitized
from tidegate.functions.filters import admit
from tidegate.functions.packets import packets, text_packets
from tidegate.operators import chunker, fanin
from tidegate.plans import media, models
from tidegate.plans.compiler import build, compile_pipeline
from tidegate.plans.nodes import REGISTRY
from tidegate.plans.registry import Registry
from tidegate.sources.files import chunked, make_wav

C = Catalogue()
QUERIES, ORACLE_SQL = C.queries, C.sql
HOUR = 3_600_000_000


def chain(df, *steps, registry=REGISTRY, output=None, **options):
    """The end of a pipeline of steps (kind and parameters) over df; output: the name of the pin to read."""
    p = compile_pipeline({"steps": [{"kind": "io::input"}, *({"kind": k, "params": v} for k, v in steps)]}, registry)
    ends = build(p, registry, {"step_0": df}, **options)
    return ends[f"step_{len(steps)}" + (f".{output}" if output else "")]


def turns(spark, sf_dir):
    return text_packets(table(spark, sf_dir, "conversations"), F.col("conv_id").cast("string"), F.col("turn"), F.col("text"))


def event_packets(spark, sf_dir):
    """Events as custom packets, in order of time within their user, with times and some durations."""
    e = table(spark, sf_dir, "events").withColumn("at", micros("ts"))
    data = F.to_json(F.struct("event_type", "value"))
    custom = F.struct(F.when(F.col("event_id") % 2 == 0, models.VAD_EVENT).otherwise(F.lit("custom/other@1")).alias("type_id"), F.lit("json").alias("encoding"), data.alias("data"))
    rank = F.row_number().over(fanin.Window.partitionBy("user_id").orderBy("ts", "event_id"))
    meta = media.timing(F.col("at"), F.round(F.col("value") * 1000), F.col("event_id"))
    return packets(e, stream_id=F.col("user_id").cast("string"), seq=rank.cast("long"), kind=F.lit("Custom"), custom=custom, metadata=meta)


@C.add(f"""WITH e AS (SELECT label, x, row_number() OVER (PARTITION BY label ORDER BY vec_id, pos) - 1 AS i FROM ({EACH})),
l AS (SELECT label, i, x, coalesce(lead(x) OVER (PARTITION BY label ORDER BY i), x) AS y, max(i) OVER (PARTITION BY label) AS m FROM e),
k AS (SELECT label, unnest(range(ceil((m + 1) * 3 / 2.0)::BIGINT)) AS k FROM (SELECT DISTINCT label, m FROM l)),
v AS (SELECT k.label, k.k, l.x + (l.y - l.x) * (k.k * 2 / 3.0 - l.i) AS value FROM k JOIN l ON l.label = k.label AND l.i = (k.k * 2) // 3)
SELECT label::VARCHAR AS stream_id, k // 480 AS seq, count(*) AS size, round(avg(value), 4) AS mean, (k // 480) * 10000 AS timestamp_us, count(*) * 1000000 // 48000 AS duration_us FROM v GROUP BY label, k // 480""")
def resampler_node(spark, sf_dir):
    """From 32 to 48 kHz, in frames of 480."""
    e = frame_packets(spark, sf_dir)
    e = e.withColumn("audio", F.col("audio").withField("sample_rate", F.lit(32_000)))
    out = chain(e, ("audio::resampler", {"target_sample_rate": 48_000, "chunk_frames": 960, "output_frame_size": 480}))
    mean = F.aggregate("audio.samples", F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size("audio.samples")
    return out.select("stream_id", "seq", F.size("audio.samples").cast("long").alias("size"), F.round(mean, 4).alias("mean"), "metadata.timestamp_us", "metadata.duration_us")


@C.add(PACED.replace("value * 1000)::BIGINT AS dur", "round(value * 1000))::BIGINT AS dur") + """SELECT user_id::VARCHAR AS stream_id, event_id, (CASE WHEN dur = 0 THEN t_us ELSE start + coalesce(sum(step) OVER (PARTITION BY user_id, segment ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END)::BIGINT AS release_us FROM d""")
def pacer_node(spark, sf_dir):
    out = chain(event_packets(spark, sf_dir), ("core::pacer", {"speed": 2.0, "initial_burst_packets": 3, "gap_ms": 12 * HOUR // 1000}))
    return out.select("stream_id", F.col("metadata.sequence").alias("event_id"), F.col("metadata.timestamp_us").alias("release_us"))


@C.add("""SELECT conv_id::VARCHAR AS stream_id, turn AS seq, 'text.received' AS event_type, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS preview, strlen(text)::BIGINT AS length FROM conversations""")
def tap_node(spark, sf_dir):
    """Events of a tap's second output; the packets go on beside them."""
    out = chain(turns(spark, sf_dir), ("core::telemetry_tap", {"packet_types": ["Text"]}), output="telemetry")
    return out.select("stream_id", "seq", "event_type", F.get_json_object("data", "$.preview").alias("preview"), F.get_json_object("data", "$.length").cast("long").alias("length"))


_TAPPED = "CASE WHEN event_id % 2 = 0 THEN 'vad.' ELSE '' END || event_type"


@C.add(f"""SELECT event_id, {_TAPPED} AS event_type, CASE WHEN event_id % 2 = 0 THEN event_type END AS source_event_type, CASE WHEN event_id % 2 = 0 THEN '{models.VAD_EVENT}' ELSE 'custom/other@1' END AS source_type_id
FROM events WHERE starts_with({_TAPPED}, 'vad') OR starts_with({_TAPPED}, 'p')""")
def tap_custom_node(spark, sf_dir):
    """Voice-activity types gain a prefix, and patterns are tried on what comes of it."""
    e = event_packets(spark, sf_dir)
    out = chain(e, ("core::telemetry_tap", {"event_type_filter": ["vad.*", "p*"], "max_events_per_sec": 1_000_000}), output="telemetry")
    out = out.join(e.select("stream_id", "seq", F.col("metadata.sequence").alias("event_id")), ["stream_id", "seq"])
    return out.select("event_id", "event_type", *(F.get_json_object("data", f"$.{c}").alias(c) for c in ("source_event_type", "source_type_id")))


@C.add("""SELECT event_id, event_type, round(value, 6) AS value FROM events WHERE event_type IN ('click', 'view')""")
def telemetry_out_node(spark, sf_dir):
    """The end of a pipeline; a second holds fewer events of a type here than the limit."""
    e = event_packets(spark, sf_dir)
    out = chain(e, ("core::telemetry_out", {"event_type_filter": ["click", "view"], "max_events_per_sec": 1_000_000}), output="telemetry")
    out = out.join(e.select("stream_id", "seq", F.col("metadata.sequence").alias("event_id")), ["stream_id", "seq"])
    return out.select("event_id", "event_type", r6(F.get_json_object("data", "$.value")).alias("value"))


@C.add("""WITH t AS (SELECT label, vec_id, embedding FROM embeddings WHERE label IN (0, 1)), n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS n FROM t),
e AS (SELECT n.n, l.pos, CASE WHEN label = 0 THEN n.embedding[l.pos // 2 + 1] ELSE n.embedding[l.pos + 1] END AS x FROM n JOIN (SELECT unnest(range(128)) AS pos) l ON l.pos < CASE WHEN label = 0 THEN 128 ELSE 64 END)
SELECT n AS seq, pos, round(sum(x::DOUBLE)::FLOAT::DOUBLE, 6) AS value FROM e GROUP BY n, pos""")
def mixer_node(spark, sf_dir):
    """A mono and a stereo input: the mono one is widened first, and the shorter frames end in silence."""
    e = fanin.numbered(frame_packets(spark, sf_dir), "stream_id", "seq").withColumn("seq", F.col("n").cast("long"))
    stereo = F.col("audio").withField("channels", F.lit(2))
    p = compile_pipeline({"nodes": {"a": {"kind": "io::input"}, "b": {"kind": "io::input"}, "mix": {"kind": "audio::mixer", "needs": ["a", "b"]}}}, REGISTRY)
    out = build(p, REGISTRY, {"a": e.where("stream_id = '0'"), "b": e.where("stream_id = '1'").withColumn("audio", stereo)})["mix"]
    rows = out.select("seq", F.posexplode("audio.samples").alias("pos", "x"))
    return rows.select("seq", F.col("pos").cast("long").alias("pos"), r6(F.col("x")).alias("value"))


@C.add("""WITH e AS (SELECT epoch_us(ts) // 3600000000 AS tick, event_type AS pin, value, row_number() OVER (PARTITION BY epoch_us(ts) // 3600000000, event_type ORDER BY ts DESC, event_id DESC) AS age FROM events WHERE event_type IN ('view', 'click')),
s AS (SELECT unnest(range(min(tick), max(tick) + 1)) AS tick FROM e), m AS (SELECT tick, sum(value::FLOAT::DOUBLE) AS mixed FROM e WHERE age <= 2 GROUP BY tick)
SELECT s.tick AS seq, round(coalesce(m.mixed, 0), 2) AS value FROM s LEFT JOIN m USING (tick)""")
def clocked_mixer_node(spark, sf_dir):
    """Hours as the clock's frames, of one sample; the newest two of each input."""
    e = table(spark, sf_dir, "events").withColumn("at", micros("ts"))
    rank = F.row_number().over(fanin.Window.partitionBy("event_type").orderBy("ts", "event_id"))
    rows = packets(e, stream_id=F.col("event_type"), seq=rank.cast("long"), kind=F.lit("Audio"), audio=media.audio(F.lit(1), F.lit(1), F.array("value")), metadata=media.timing(F.col("at"), F.lit(None), F.lit(None)))
    params = {"clocked": True, "sample_rate": 1, "frame_samples_per_channel": 3600, "jitter_buffer_frames": 2}
    p = compile_pipeline({"nodes": {"a": {"kind": "io::input"}, "b": {"kind": "io::input"}, "mix": {"kind": "audio::mixer", "needs": ["a", "b"], "params": params}}}, REGISTRY)
    out = build(p, REGISTRY, {"a": rows.where("stream_id = 'view'"), "b": rows.where("stream_id = 'click'")})["mix"]
    return out.select("seq", F.round(F.element_at("audio.samples", 1).cast("double"), 2).alias("value"))


@C.add("""WITH t AS (SELECT DISTINCT epoch_us(ts) // 3600000000 AS tick FROM events), h AS (SELECT DISTINCT epoch_us(ts) // 3600000000 AS tick, event_type AS pin FROM events WHERE event_type IN ('view', 'error')),
p AS (SELECT pin, min(tick) AS a FROM h GROUP BY pin), m AS (SELECT p.pin, t.tick, h.tick IS NOT NULL AS here FROM p JOIN t ON t.tick >= p.a LEFT JOIN h ON h.pin = p.pin AND h.tick = t.tick),
c AS (SELECT *, lag(here) OVER (PARTITION BY pin ORDER BY tick) AS before FROM m)
SELECT pin, tick, CASE WHEN here THEN 'recovered' ELSE 'slow' END AS change FROM c WHERE here <> before""")
def mixer_slow(spark, sf_dir):
    """Inputs of a mixer that miss a tick of the others, and that come back."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("pin"), F.floor(micros("ts") / HOUR).alias("tick"))
    ticks = e.withColumn("pin", F.when(F.col("pin").isin("view", "error"), F.col("pin")).otherwise("others"))
    return fanin.slow_inputs(ticks, ["view", "error"])


@C.add(f"""SELECT vec_id::VARCHAR AS stream_id, pos, round(greatest(least(round_even((x::FLOAT * 32767::FLOAT)::DOUBLE, 0), 32767), -32768) / 32768, 6) AS value FROM ({EACH})""")
def wav_node(spark, sf_dir):
    """Frames as WAV files that arrive in pieces of 50 bytes."""

    def file(samples: pd.Series) -> pd.Series:
        return samples.map(lambda x: make_wav(16_000, 1, np.asarray(x, np.float32)))

    file.__annotations__ = {"samples": pd.Series, "return": pd.Series}
    files = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("stream_id"), F.pandas_udf(file, "binary")("embedding").alias("file"))
    pieces = chunked(files, F.col("file"), 50, "stream_id")
    binary = F.struct("data", F.lit(None).cast("string").alias("content_type"))
    out = chain(packets(pieces, seq=F.col("chunk_no"), kind=F.lit("Binary"), binary=binary), ("containers::wav::demuxer", {}))
    rows = out.select("stream_id", F.posexplode("audio.samples").alias("pos", "x"))
    return rows.select("stream_id", F.col("pos").cast("long").alias("pos"), r6(F.col("x")).alias("value"))


@C.add("""WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations WHERE strlen(text) > 0),
d AS (SELECT conv_id, n, md5(text) AS digest, n * 960 * 1000000 // 48000 AS timestamp_us, CASE WHEN n > 0 THEN 20000 END AS duration_us FROM c)
SELECT conv_id::VARCHAR AS stream_id, n + 3 AS seq, digest, CASE WHEN n > 0 THEN timestamp_us END AS timestamp_us, duration_us::BIGINT AS duration_us FROM d""")
def ogg_round_trip(spark, sf_dir):
    """Turns as packets of an Ogg stream, cut into pieces of 100 bytes, and read again; two header packets come first."""
    rows = turns(spark, sf_dir).where("text <> ''")
    binary = F.struct(F.encode("text", "UTF-8").alias("data"), F.lit(None).cast("string").alias("content_type"))
    pages = chain(packets(rows, kind=F.lit("Binary"), text=F.lit(None), binary=binary), ("containers::ogg::muxer", {"stream_serial": 7}))
    pieces = chunked(pages, F.col("binary.data"), 100, "stream_id", "seq")
    order = F.row_number().over(fanin.Window.partitionBy("stream_id").orderBy("seq", "chunk_no"))
    binary = F.struct("data", F.lit(None).cast("string").alias("content_type"))
    out = chain(packets(pieces.withColumn("seq", order.cast("long")), kind=F.lit("Binary"), binary=binary), ("containers::ogg::demuxer", {}))
    return out.where("seq > 2").select("stream_id", "seq", F.md5("binary.data").alias("digest"), "metadata.timestamp_us", "metadata.duration_us")


def _loud(samples: np.ndarray) -> np.ndarray:
    return np.abs(samples.astype(np.float64)).mean(axis=1)


def _registry() -> Registry:
    """Nodes around stand-ins for models."""
    own = Registry()
    own.kinds.update(REGISTRY.kinds)
    models.vad("plugin::native::vad", _loud, own)
    models.speech_to_text("plugin::native::sensevoice", None, lambda x: f"<|en|> {len(x)} samples", own)
    models.speech_to_text("plugin::native::whisper", _loud, lambda x: f"{len(x)} samples", own)
    models.translator("plugin::native::nllb", lambda t: f"<unk> xx {t} ", registry=own)
    models.translator("plugin::native::helsinki", lambda t: f"yy {t}", ("en", "es"), own)
    models.text_to_speech("plugin::native::piper", lambda t: np.full(len(t), 0.5), 22_050, "wide", False, own)
    models.text_to_speech("plugin::native::kokoro", lambda t: np.full(len(t), 0.5), 24_000, "cjk", True, own)
    models.text_to_speech("plugin::native::matcha", lambda t: np.full(len(t), 0.5), 22_050, "ascii", True, own)
    return own


def voices(spark, sf_dir):
    e = frame_packets(spark, sf_dir)
    return e.withColumn("audio", F.col("audio").withField("sample_rate", F.lit(16_000)))


_HEARD = f"""WITH e AS (SELECT label, x, row_number() OVER (PARTITION BY label ORDER BY vec_id, pos) - 1 AS i FROM ({EACH})),
w AS (SELECT label, i // 512 AS w, avg(abs(x)) AS p FROM e GROUP BY label, i // 512 HAVING count(*) = 512)"""


@C.add(_HEARD + """, s AS (SELECT *, p >= 0.1 AS sp, coalesce(lag(p >= 0.1) OVER (PARTITION BY label ORDER BY w), FALSE) AS was FROM w), c AS (SELECT * FROM s WHERE sp <> was)
SELECT label::VARCHAR AS stream_id, w * 32 AS timestamp_ms, CASE WHEN sp THEN 'speech_start' ELSE 'speech_end' END AS event_type, CASE WHEN NOT sp THEN (w - lag(w) OVER (PARTITION BY label ORDER BY w)) * 32 END AS duration_ms FROM c""")
def vad_node(spark, sf_dir):
    out = chain(voices(spark, sf_dir), ("plugin::native::vad", {"threshold": 0.1}), registry=_registry())
    return out.select("stream_id", *(F.get_json_object("custom.data", f"$.{c}").cast(t).alias(c) for c, t in (("timestamp_ms", "long"), ("event_type", "string"), ("duration_ms", "long"))))


@C.add(_HEARD + """ SELECT label::VARCHAR AS stream_id, w // 4 AS seq, count(*) * 512 || ' samples' AS text, 'en' AS language, (w // 4) * 128 AS start_ms, (w // 4) * 128 + count(*) * 32 AS end_ms FROM w GROUP BY label, w // 4""")
def sensevoice_node(spark, sf_dir):
    """Without voice activity: segments of a fixed length, here of four windows; the model's tag gives the language."""
    out = chain(voices(spark, sf_dir), ("plugin::native::sensevoice", {"use_vad": False, "max_segment_duration_secs": 0.128}), registry=_registry())
    one = F.element_at("transcription.segments", 1)
    return out.select("stream_id", "seq", "transcription.text", "transcription.language", one["start_time_ms"].alias("start_ms"), one["end_time_ms"].alias("end_ms"))


@C.add(_HEARD + """, v AS (SELECT label, w FROM w WHERE p >= 0.1), f AS (SELECT *, CASE WHEN w - lag(w) OVER (PARTITION BY label ORDER BY w) <= 2 THEN 0 ELSE 1 END AS fresh FROM v),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY label ORDER BY w ROWS UNBOUNDED PRECEDING) AS g FROM f)
SELECT label::VARCHAR AS stream_id, (g - 1)::BIGINT AS seq, count(*) * 512 || ' samples' AS text, min(w) * 32 AS start_ms, (max(w) + 1) * 32 AS end_ms FROM g GROUP BY label, g""")
def whisper_node(spark, sf_dir):
    """Segments end after two silent windows in a row, which aren't part of them."""
    out = chain(voices(spark, sf_dir), ("plugin::native::whisper", {"vad_threshold": 0.1, "min_silence_duration_ms": 64, "max_segment_duration_secs": 1e6}), registry=_registry())
    one = F.element_at("transcription.segments", 1)
    return out.select("stream_id", "seq", "transcription.text", one["start_time_ms"].alias("start_ms"), one["end_time_ms"].alias("end_ms"))


@C.add("SELECT conv_id::VARCHAR AS stream_id, turn AS seq, 'yy xx ' || trim(text) AS text FROM conversations WHERE trim(text) <> ''")
def translator_nodes(spark, sf_dir):
    out = chain(turns(spark, sf_dir).withColumn("text", F.trim("text")), ("plugin::native::nllb", {}), ("plugin::native::helsinki", {"source_language": "es", "target_language": "en"}), registry=_registry())
    return out.select("stream_id", "seq", "text")


def _spoken(kept: str, ends: str, flush: bool) -> str:
    cuts = _cuts(chunker.SENTENCES, 10, list(chunker.SENTENCE_ENDS)).replace("FROM documents", "FROM clean")
    if not flush:
        cuts = cuts[: cuts.index("UNION ALL SELECT doc_id")]
    body = cuts.replace("WITH RECURSIVE", f"WITH RECURSIVE clean AS (SELECT doc_id, clean AS text FROM ({_sanitized(kept, ends)}) WHERE clean <> ''),", 1)
    return f"SELECT doc_id, chunk_no AS seq, length(chunk)::BIGINT AS n_samples FROM ({body})"


def _speak(spark, sf_dir, kind):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    out = chain(text_packets(docs, F.col("doc_id").cast("string"), F.lit(0), F.col("text")), (f"plugin::native::{kind}", {}), registry=_registry())
    return out.select(F.col("stream_id").cast("long").alias("doc_id"), "seq", F.size("audio.samples").cast("long").alias("n_samples"))


@C.add(_spoken("A-Za-z0-9 .,!?\\-''\"\\n:;¡¿À-Ÿ", ".!?", False))
def piper_node(spark, sf_dir):
    """Cleaned, cut into sentences, spoken; what is left at the end is dropped."""
    return _speak(spark, sf_dir, "piper")


@C.add(_spoken("A-Za-z0-9 .,!?\\-''\"\\n:;À-Ÿ一-鿿。，！？、；：（）", ".!?。！？", True))
def kokoro_node(spark, sf_dir):
    return _speak(spark, sf_dir, "kokoro")


@C.add(_spoken("A-Za-z0-9 .,!?\\-''\"\\n:;", ".!?", True))
def matcha_node(spark, sf_dir):
    return _speak(spark, sf_dir, "matcha")


@C.add("SELECT conv_id::VARCHAR AS stream_id, turn AS seq, CASE WHEN turn % 3 = 1 THEN upper(role) ELSE text END AS text FROM conversations WHERE turn % 3 <> 0")
def script_node(spark, sf_dir):
    """A script that drops every third packet, gives a new text for the next, and for the others a result that isn't a text."""
    role = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("stream_id"), F.col("turn").alias("seq"), F.struct(F.lit("role").alias("type_id"), F.lit("json").alias("encoding"), F.col("role").alias("data")).alias("custom"))
    rows = packets(turns(spark, sf_dir).drop("custom").join(role, ["stream_id", "seq"]))
    third = F.col("seq") % 3
    made = lambda df: F.struct((third == 0).alias("drop"), F.when(third == 1, "Text").otherwise("Audio").alias("type"), F.upper("custom.data").alias("text"))
    return chain(rows, ("core::script", {"process": made})).select("stream_id", "seq", "text")


@C.add("""WITH b AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'audio/ogg' END AS own FROM conversations)
SELECT conv_id::VARCHAR AS stream_id, turn AS seq, coalesce(own, 'application/octet-stream') AS own_type, 'text/plain' AS set_type FROM b""")
def output_node(spark, sf_dir):
    """The content type that is configured, else the packet's own, else that of plain bytes."""
    own = F.when(F.col("seq") % 2 == 0, F.lit("audio/ogg"))
    rows = packets(turns(spark, sf_dir), kind=F.lit("Binary"), binary=F.struct(F.encode("text", "UTF-8").alias("data"), own.alias("content_type")))
    a, b = (chain(rows, ("io::output", p)).select("stream_id", "seq", F.col("binary.content_type").alias(n)) for p, n in (({}, "own_type"), ({"content_type": "text/plain"}, "set_type")))
    return a.join(b, ["stream_id", "seq"])


@C.add("""SELECT user_id::VARCHAR AS stream_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 86400000000 ORDER BY ts, event_id) AS k FROM events) WHERE k <= 2""")
def best_effort_connection(spark, sf_dir):
    """A best-effort connection of two packets for each stream and tick (a day here) drops what comes after them."""
    e = event_packets(spark, sf_dir)
    e = e.withColumn("metadata", F.col("metadata").withField("timestamp_us", F.floor(F.col("metadata.timestamp_us") / (24 * HOUR)) * F.lit(24 * HOUR)))
    p = compile_pipeline({"nodes": {"in": {"kind": "io::input"}, "out": {"kind": "io::output", "needs": {"node": "in", "mode": "best_effort"}}}}, REGISTRY)
    return build(p, REGISTRY, {"in": e}, capacity=2)["out"].select("stream_id", F.col("metadata.sequence").alias("event_id"))


@C.add("""SELECT event_id, event_type IN ('click', 'view') AS handled FROM events""")
def forwarded_kinds(spark, sf_dir):
    """A node that forwards packets which it doesn't take."""
    rows = table(spark, sf_dir, "events").withColumn("kind", F.col("event_type"))
    return admit(rows, ["Click", "View"], "forward").select("event_id", "handled")


@C.add("""SELECT conv_id::VARCHAR AS stream_id, turn AS seq, strlen(text)::BIGINT AS n_samples, (turn - 1)::BIGINT AS place FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn FROM conversations WHERE strlen(text) >= 10 AND NOT starts_with(text, 'OpusHead') AND NOT starts_with(text, 'OpusTags'))""")
def decoder_node(spark, sf_dir):
    """A codec given by its user: packets too small for a frame, and headers, are skipped, and frames are timed."""
    own = Registry()
    own.kinds.update(REGISTRY.kinds)
    media.codec("audio::opus::decoder", lambda d: np.zeros(len(d), np.float32), 48_000, 1, registry=own)
    rows = turns(spark, sf_dir)
    rows = packets(rows, kind=F.lit("Binary"), text=F.lit(None), binary=F.struct(F.encode("text", "UTF-8").alias("data"), F.lit(None).cast("string").alias("content_type")))
    out = chain(rows, ("audio::opus::decoder", {}), registry=own)
    return out.select("stream_id", (F.col("metadata.sequence") + 1).alias("seq"), F.size("audio.samples").cast("long").alias("n_samples"), F.col("metadata.sequence").alias("place"))


@C.add(f"""WITH e AS (SELECT label, x, row_number() OVER (PARTITION BY label ORDER BY vec_id, pos) - 1 AS i FROM ({EACH}))
SELECT label::VARCHAR AS stream_id, i // 1920 AS seq, count(*) AS size, (i // 1920) * 1920 * 1000000 // 48000 AS timestamp_us FROM e GROUP BY label, i // 1920""")
def file_decoder_node(spark, sf_dir):
    """A codec that takes whole files: its samples leave in frames of 1920."""
    own = Registry()
    own.kinds.update(REGISTRY.kinds)
    media.codec("audio::mp3::decoder", lambda d: np.frombuffer(d, "<f4"), 48_000, 1, whole=True, registry=own)

    def raw(samples: pd.Series) -> pd.Series:
        return samples.map(lambda x: np.asarray(x, "<f4").tobytes())

    raw.__annotations__ = {"samples": pd.Series, "return": pd.Series}
    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("stream_id"), F.col("vec_id").alias("seq"), F.pandas_udf(raw, "binary")("embedding").alias("data"))
    binary = F.struct("data", F.lit(None).cast("string").alias("content_type"))
    out = chain(packets(e, kind=F.lit("Binary"), binary=binary), ("audio::mp3::decoder", {}), registry=own)
    return out.select("stream_id", "seq", F.size("audio.samples").cast("long").alias("size"), "metadata.timestamp_us")


@C.add("""SELECT vec_id::VARCHAR AS stream_id, 96 * 4 AS n_bytes, 96 * 1000000 // 48000 AS duration_us FROM embeddings""")
def encoder_node(spark, sf_dir):
    """Short frames are padded before they are encoded, and every packet has the duration of a frame."""
    own = Registry()
    own.kinds.update(REGISTRY.kinds)
    media.encoder("audio::opus::encoder", lambda x: x.tobytes(), 96, own)
    out = chain(frame_packets(spark, sf_dir).withColumn("stream_id", F.col("seq").cast("string")), ("audio::opus::encoder", {}), registry=own)
    return out.select("stream_id", F.octet_length("binary.data").alias("n_bytes"), "metadata.duration_us")
