"""Packets as telemetry events, spans, and the per-key rate limit with its health counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.functions.text import glob_any, kind_in, preview
from tidegate.operators.ordering import ordered, runs

PREVIEW = 100
# Fixed value: the type of voice-activity events, which a tap renames.
VAD_TYPE = "plugin::native::vad/vad-event@1"
#: Columns of an event.
EVENT = ("stream_id", "seq", "event_type", "data", "timestamp_us")


def with_fields(data: Column, **fields: Column) -> Column:
    """A JSON object with more fields (null ones are left out); anything else becomes the field `value` of one."""
    body = F.trim(data)
    extra = F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())))
    inside = F.substring(extra, F.lit(2), F.length(extra) - 2)
    rest = F.trim(F.substring(body, F.lit(2), F.length(body) - 2))
    whole = body.startswith("{")
    own = F.when(whole, rest).otherwise(F.concat(F.lit('"value":'), F.coalesce(body, F.lit("null"))))
    return F.concat(F.lit("{"), F.array_join(F.filter(F.array(own, inside), lambda p: p != ""), ","), F.lit("}"))


def packet_events(packets: DataFrame, packet_types: list[str] | None = None, patterns: list[str] | None = None, tap: bool = False) -> DataFrame:
    """Packets (functions.packets.SCHEMA) as events: `stt.result`, the type of a custom event, `text.received` and
    `binary.received`; audio makes none here. tap: voice-activity types get a prefix and keep their own name beside it.

    Patterns apply to custom events alone; no pattern lets all through."""
    named = F.coalesce(F.get_json_object("custom.data", "$.event_type"), F.lit("custom.unknown"))
    renamed = F.lit(tap) & (F.col("custom.type_id") == VAD_TYPE)
    kind = F.when(F.col("kind") == "Custom", F.when(renamed, F.concat(F.lit("vad."), named)).otherwise(named))
    for name, event in (("Transcription", "stt.result"), ("Text", "text.received"), ("Binary", "binary.received")):
        kind = F.when(F.col("kind") == name, F.lit(event)).otherwise(kind)
    said = F.col("transcription")
    spoken = {"text_preview": preview(said["text"], PREVIEW), "segment_count": F.size(said["segments"])}
    spoken |= {"segments": said["segments"]} if tap else {"text_length": F.octet_length(said["text"]), "language": said["language"]}
    sized = {"size" if tap else "size_bytes": F.octet_length("binary.data"), "has_metadata": F.col("metadata").isNotNull()}
    read = {"preview" if tap else "text_preview": preview(F.col("text"), PREVIEW), "length": F.octet_length("text")}
    body = with_fields(F.col("custom.data"), source_type_id=F.col("custom.type_id"), source_event_type=F.when(renamed, named))
    for name, fields in (("Transcription", spoken), ("Text", read), ("Binary", sized)):
        body = F.when(F.col("kind") == name, F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())))).otherwise(body)
    rows = packets.where(kind_in(F.col("kind"), packet_types)) if packet_types is not None else packets
    rows = rows.where("kind <> 'Audio'").withColumn("event_type", kind).withColumn("data", body)
    rows = rows.where((F.col("kind") != "Custom") | glob_any(F.col("event_type"), patterns or []))
    return rows.select("stream_id", "seq", "event_type", with_fields(F.col("data"), event_type=F.col("event_type")).alias("data"), F.col("metadata.timestamp_us").alias("timestamp_us"))


def audio_levels(packets: DataFrame, every_us: int) -> DataFrame:
    """`audio.level` events: root mean square, peak and number of the samples of each stream in each interval of event time."""
    rows = packets.where("kind = 'Audio' and metadata.timestamp_us is not null")
    x = F.col("audio.samples")
    square = F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    top = F.aggregate(x, F.lit(0.0), lambda a, v: F.greatest(a, F.abs(v.cast("double"))))
    at = F.floor(F.col("metadata.timestamp_us") / every_us).cast("long")
    rows = rows.select("stream_id", "seq", at.alias("at"), square.alias("square"), top.alias("top"), F.size(x).alias("n"), "audio.sample_rate", "audio.channels")
    got = rows.groupBy("stream_id", "at").agg(F.max("seq").alias("seq"), F.sum("square").alias("square"), F.max("top").alias("peak"), F.sum("n").alias("n"), F.max_by(F.struct("sample_rate", "channels"), "seq").alias("last"))
    rms = F.when(F.col("n") > 0, F.sqrt(F.col("square") / F.col("n"))).otherwise(F.lit(0.0))
    body = F.to_json(F.struct(F.lit("audio.level").alias("event_type"), rms.alias("rms"), "peak", F.col("n").alias("sample_count"), "last.sample_rate", "last.channels"))
    return got.select("stream_id", "seq", F.lit("audio.level").alias("event_type"), body.alias("data"), (F.col("at") * every_us).alias("timestamp_us"))


def limited_events(events: DataFrame, most: int, window_us: int = 1_000_000) -> DataFrame:
    """Events that the limit of each stream and type lets through; those without a time aren't limited."""
    timed = events.where("timestamp_us is not null")
    allowed = rate_limited(timed, ["stream_id", "event_type"], "timestamp_us", "seq", window_us, most, ["data"]).where("allowed")
    return allowed.select(*EVENT).unionByName(events.where("timestamp_us is null").select(*EVENT))


def text_events(packets: DataFrame, text: Column, *keep: str) -> DataFrame:
    """`text.received`: a preview and the length in bytes."""
    return packets.select(*keep, F.lit("text.received").alias("event_type"), preview(text, PREVIEW).alias("preview"), F.octet_length(text).cast("long").alias("length"))


def custom_events(packets: DataFrame, kind: Column, patterns: list[str], vad: bool, type_id: str, *keep: str) -> DataFrame:
    """Events named after the packet's own type (`custom.unknown` if it has none), voice-activity types with a prefix.

    Patterns apply to the final name; no pattern lets all through."""
    name = F.coalesce(kind, F.lit("custom.unknown"))
    final = F.concat(F.lit("vad."), name) if vad else name
    rows = packets.select(*keep, final.alias("event_type"), F.lit(type_id).alias("source_type_id"), (name if vad else F.lit(None).cast("string")).alias("source_event_type"))
    return rows.where(glob_any(F.col("event_type"), patterns))


def transcription_events(packets: DataFrame, text: Column, segments: Column, language: Column, *keep: str) -> DataFrame:
    """`stt.result`: a preview, the text's length in bytes, the number of segments, and the language."""
    return packets.select(*keep, F.lit("stt.result").alias("event_type"), preview(text, PREVIEW).alias("text_preview"), F.octet_length(text).cast("long").alias("text_length"), F.size(segments).cast("long").alias("segment_count"), language.alias("language"))


def lagged(df: DataFrame, stream: str, order: list[str], read: Column, capacity: int) -> DataFrame:
    """Packets that a subscriber of a broadcast ring misses. read: how many packets it had read when each was sent; one
    that is more than `capacity` behind loses what has been overwritten: lost counts those packets."""
    rows = df.withColumn("sent", F.row_number().over(ordered([stream], order)).cast("long"))
    return rows.withColumn("lost", F.greatest(F.col("sent") - read - capacity, F.lit(0)).cast("long"))


def envelope(data: Column, event_type: Column | str, correlation: Column | None = None, turn: Column | None = None) -> Column:
    """A JSON value as an event: its type and ids join an object, other values become its `value`."""
    kind = F.lit(event_type) if isinstance(event_type, str) else event_type
    none = F.lit(None).cast("string")
    return with_fields(data, event_type=kind, correlation_id=none if correlation is None else correlation, turn_id=none if turn is None else turn)


def map_envelope(data: Column, event_type: Column | str, correlation: Column | None = None, turn: Column | None = None) -> Column:
    return envelope(F.to_json(data), event_type, correlation, turn)


def only_kinds(packets: DataFrame, kind: str, kinds: list[str]) -> DataFrame:
    return packets.where(kind_in(F.col(kind), kinds))


def spans(df: DataFrame, stream: str, order: list[str], at_us: Column, opens: Column, closes: Column) -> DataFrame:
    """One row per end that has a start before it in its stream: start_us, end_us, latency_us. The nearest start counts."""
    from tidegate.operators.ordering import before

    rows = df.withColumn("__at", at_us)
    start = F.last(F.when(opens, F.col("__at")), ignorenulls=True).over(before([stream], order))
    rows = rows.withColumn("start_us", start).where(closes & F.col("start_us").isNotNull())
    return rows.withColumn("end_us", F.col("__at")).withColumn("latency_us", F.col("end_us") - F.col("start_us")).drop("__at")


def spans_by_id(df: DataFrame, stream: str, span: str, at_us: Column, opens: Column, closes: Column, data: Column) -> DataFrame:
    """One row per span that has both ends, whatever lies between: start_us, end_us, latency_us, and the data (a map) of both,
    where the end's values win. A span that opens or closes twice counts from the first to the first after it."""
    rows = df.select(stream, span, at_us.alias("__at"), opens.alias("__o"), closes.alias("__c"), data.alias("__d"))
    starts = rows.where("__o").groupBy(stream, span).agg(F.min("__at").alias("start_us"), F.min_by("__d", "__at").alias("__first"))
    ends = rows.where("__c").join(starts, [stream, span]).where("__at >= start_us")
    found = ends.groupBy(stream, span).agg(F.first("start_us").alias("start_us"), F.min("__at").alias("end_us"), F.first("__first").alias("__first"), F.min_by("__d", "__at").alias("__last"))
    kept = F.map_filter("__first", lambda k, _: ~F.map_contains_key("__last", k))
    return found.select(stream, span, "start_us", "end_us", (F.col("end_us") - F.col("start_us")).alias("latency_us"), F.map_concat(kept, "__last").alias("data"))


def rate_limited(df: DataFrame, keys: list[str], at: str, tie: str, window_us: int, most: int, keep: list[str] | None = None) -> DataFrame:
    """df: the keys, at (microseconds), tie. Adds allowed by a window that the first event of a key opens, and that the
    first event after its end opens anew; in it `most` events pass (one passes even if most is 0)."""
    import numpy as np

    def step(state, part):
        """A key's next rows: from window to window, whatever their number."""
        times = part.column(at).to_numpy()
        allowed = np.zeros(len(times), bool)
        start, n = state or (None, 0)
        i = 0
        while i < len(times):
            end = int(np.searchsorted(times, start + window_us)) if start is not None else i
            if end > i:
                allowed[i : min(i + max(most - n, 0), end)] = True
                n, i = min(n + end - i, max(most, n)), end
            else:
                start, n = int(times[i]), 1
                allowed[i] = True
                i += 1
        return (start, n), part.append_column("allowed", [allowed])

    types = dict(df.dtypes)
    columns = [*keys, at, tie, *(keep or [])]
    return runs(df.select(*columns), keys, [at, tie], step, ", ".join(f"{c} {types[c]}" for c in columns) + ", allowed boolean")


def drop_health(limited: DataFrame, keys: list[str]) -> DataFrame:
    return limited.groupBy(*keys).agg(F.count("*").alias("events"), F.count_if(~F.col("allowed")).alias("dropped")).where("dropped > 0")


def drop_health_events(limited: DataFrame, keys: list[str], at: str, every_us: int) -> DataFrame:
    """`telemetry.health` rows: of each key and interval, what was dropped in it; an interval without drops makes none, and
    counts begin anew with each."""
    begin = (F.floor(F.col(at) / every_us) * every_us).cast("long").alias("start_us")
    return limited.groupBy(*keys, begin).agg(F.count("*").alias("events"), F.count_if(~F.col("allowed")).alias("dropped")).where("dropped > 0")


def latest_before(df: DataFrame, controls: DataFrame, stream: str, at: str, tie: str, value: str) -> DataFrame:
    """As-of lookup: the last control of a row's stream at or before it. df and controls are merged in order, not joined.

    df: stream, at, tie and others; controls: stream, at, value."""
    rows = df.withColumn("__set", F.lit(None).cast(dict(controls.dtypes)[value])).withColumn("__row", F.lit(True))
    marks = controls.select(F.col(stream), F.col(at), F.lit(None).cast(dict(df.dtypes)[tie]).alias(tie), F.col(value).alias("__set"), F.lit(False).alias("__row"))
    both = rows.unionByName(marks, allowMissingColumns=True)
    w = ordered([stream], [F.col(at), F.col("__row"), F.col(tie)])
    found = both.withColumn("current", F.last("__set", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return found.where("__row").drop("__set", "__row")
