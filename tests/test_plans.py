"""The compiler, type rules, and pipelines end to end in batch and in streaming."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidegate.functions.packets import audio_packets, text_packets
from tidegate.plans.compiler import PipelineError, build, check, compile_pipeline, fuse_gains, levels, load, output_types
from tidegate.plans.nodes import REGISTRY, plugin
from tidegate.plans.registry import allowed
from tidegate.plans.types import ANY, BINARY, PASSTHROUGH, TEXT, can_connect, custom, raw_audio
from tidegate.streaming.engine import Sessions, run_batch


def dag(**needs):
    return {"nodes": {n: {"kind": k, **({"needs": own} if own else {})} for n, (k, own) in needs.items()}}


def test_steps():
    p = load("""
name: double
steps:
  - kind: io::input
  - kind: audio::gain
    params: {gain: 2.0}
  - kind: io::output
""")
    assert list(p.nodes) == ["step_0", "step_1", "step_2"] and [(c.source, c.target, c.pin) for c in p.connections] == [("step_0", "step_1", "in"), ("step_1", "step_2", "in")]
    assert p.nodes["step_1"].params == {"gain": 2.0} and p.name == "double" and p.mode == "dynamic"


def test_needs():
    p = compile_pipeline(dag(a=("io::input", None), b=("io::input", None), m=("audio::mixer", ["a", {"node": "b", "mode": "best_effort"}])))
    assert [(c.source, c.pin, c.mode) for c in p.connections] == [("a", "in_0", "reliable"), ("b", "in_1", "best_effort")]
    assert p.nodes["m"].params["num_inputs"] == 2
    assert levels(p) == {"a": 0, "b": 0, "m": 1}
    single = compile_pipeline(dag(a=("io::input", None), b=("core::sink", ["a"])))
    assert single.connections[0].pin == "in"


@pytest.mark.parametrize(
    "spec,says",
    [
        (dag(a=("io::input", "a")), "'a' needs itself"),
        (dag(a=("io::input", "b")), "'b'"),
        (dag(a=("core::passthrough", "b"), b=("core::passthrough", "a")), "cycle"),
        ({"steps": [], "nodes": {}}, "either"),
        (dag(a=("io::input", None), b=("core::sink", {"node": "a", "mode": "odd"})), "odd"),
    ],
)
def test_errors(spec, says):
    with pytest.raises(PipelineError, match=says):
        compile_pipeline(spec, REGISTRY)


def test_a_cycle_through_a_peer_is_allowed():
    p = compile_pipeline(dag(p=("transport::peer", "g"), g=("core::passthrough", "p")), REGISTRY)
    assert len(p.connections) == 2


def test_types():
    assert can_connect(ANY, TEXT) and can_connect(TEXT, ANY) and can_connect(TEXT, TEXT) and not can_connect(TEXT, BINARY)
    assert can_connect(raw_audio(48_000, 2), raw_audio()) and can_connect(raw_audio(48_000, 0), raw_audio(48_000, 2))
    assert not can_connect(raw_audio(48_000, 2), raw_audio(44_100, 2)) and not can_connect(raw_audio(0, 0, "F32"), raw_audio(0, 0, "S16"))
    assert can_connect(custom("a@1"), custom("a@1")) and not can_connect(custom("a@1"), custom("b@1"))
    assert not can_connect(PASSTHROUGH, TEXT) and can_connect(PASSTHROUGH, ANY)


def test_checks():
    chain = {"steps": [{"kind": "core::file_reader", "params": {"path": "x"}}, {"kind": "core::passthrough"}, {"kind": "audio::gain"}]}
    with pytest.raises(PipelineError, match="doesn't fit"):
        check(compile_pipeline(chain), REGISTRY)
    fan = compile_pipeline(dag(a=("io::input", None), b=("core::sink", "a"), c=("core::sink", "a")))
    check(fan, REGISTRY)
    with pytest.raises(PipelineError, match="linear"):
        check(fan, REGISTRY, linear=True)
    with pytest.raises(PipelineError, match="no input"):
        check(compile_pipeline(dag(a=("io::input", None), b=("io::input", "a"))), REGISTRY)
    with pytest.raises(ValueError, match="missing"):
        check(compile_pipeline({"steps": [{"kind": "core::file_reader"}]}), REGISTRY)
    with pytest.raises(ValueError, match="unknown node kind"):
        check(compile_pipeline({"steps": [{"kind": "no::such"}]}), REGISTRY)
    inferred = compile_pipeline({"steps": [{"kind": "core::json_serialize"}, {"kind": "core::passthrough"}]})
    assert output_types(inferred, REGISTRY) == {"step_0.out": "Binary", "step_1.out": "Binary"}


def test_gains_fuse_unless_read_between():
    steps = {"steps": [{"kind": "io::input"}, *[{"kind": "audio::gain", "params": {"gain": 2.0}}] * 3]}
    assert [n.params for n in fuse_gains(compile_pipeline(steps)).nodes.values()] == [{}, {"gain": 2.0, "chain": (2.0, 2.0)}]
    read = dag(a=("io::input", None), g=("audio::gain", "a"), h=("audio::gain", "g"), s=("core::sink", "g"))
    assert len(fuse_gains(compile_pipeline(read)).nodes) == 4


def test_registry():
    kinds = {d["kind"] for d in REGISTRY.definitions()}
    assert {"core::passthrough", "audio::gain", "audio::mixer", "core::text_chunker", "core::sink"} <= kinds
    assert allowed("audio::gain", ["audio::*"]) and not allowed("audio::gain", []) and not allowed("core::script", ["audio::*"])


def audio(spark, values, stream="s"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "n long, x array<float>")
    return audio_packets(rows, F.lit(stream), F.col("n"), F.col("x"), 48_000)


def test_batch(spark):
    a, b = audio(spark, [[0.1] * 4, [0.0]]), audio(spark, [[0.2] * 4], "t")
    spec = dag(a=("io::input", None), b=("io::input", None), m=("audio::mixer", ["a", "b"]), o=("io::output", "m"))
    out = build(compile_pipeline(spec), REGISTRY, {"a": a, "b": b})
    got = out["o"].orderBy("seq").collect()
    assert list(got[0].audio.samples) == pytest.approx([0.3] * 4) and list(got[1].audio.samples) == [0.0]
    text = text_packets(spark.createDataFrame([(1, "One here. Two here.")], "n long, t string"), F.lit("s"), F.col("n"), F.col("t"))
    ends = run_batch("steps: [{kind: 'io::input'}, {kind: 'core::text_chunker'}, {kind: 'core::json_serialize', params: {newline_delimited: true}}]", REGISTRY, {"step_0": text})
    assert [bytes(r.binary.data).decode() for r in ends["step_2"].orderBy("seq").collect()] == ['{"Text":"One here."}\n', '{"Text":"Two here."}\n']
    tapped = build(compile_pipeline({"steps": [{"kind": "io::input"}, {"kind": "core::telemetry_tap", "params": {"packet_types": ["text"]}}, {"kind": "core::filter", "params": {"packet_types": ["text"]}}]}), REGISTRY, {"step_0": text})
    assert tapped["step_1.telemetry"].first().event_type == "text.received" and tapped["step_2"].count() == 1


def steps(df, *nodes, output=None, **options):
    ends = build(compile_pipeline({"steps": [{"kind": "io::input"}, *({"kind": k, "params": p} for k, p in nodes)]}), REGISTRY, {"step_0": df}, **options)
    return ends[f"step_{len(nodes)}" + (f".{output}" if output else "")]


def mixed(inputs, **params):
    spec = {"nodes": {**{n: {"kind": "io::input"} for n in inputs}, "m": {"kind": "audio::mixer", "needs": list(inputs), "params": params}}}
    return [(r.seq, r.audio.channels, list(r.audio.samples)) for r in build(compile_pipeline(spec), REGISTRY, inputs)["m"].orderBy("seq").collect()]


def test_gains_are_checked_before_they_fuse(spark):
    a = audio(spark, [[1.0]])
    for bad in ([10.0, -0.5], [0.5, 4.1], [float("nan"), 1.0]):
        with pytest.raises(ValueError, match="gain"):
            steps(a, *(("audio::gain", {"gain": g}) for g in bad))
    # Each step rounds to 32 bits, as two nodes would.
    import numpy as np

    x, g, h = np.float32(0.1), 0.7, 1.3
    out = steps(audio(spark, [[float(x)]]), ("audio::gain", {"gain": g}), ("audio::gain", {"gain": h})).first().audio.samples[0]
    assert np.float32(out) == np.float32(np.float64(np.float32(np.float64(x) * g)) * h)


def test_mixer_widens_channels_and_keeps_them(spark):
    stereo = audio(spark, [[10.0, 20.0, 30.0, 40.0]], "t").withColumn("audio", F.col("audio").withField("channels", F.lit(2)))
    mono = audio(spark, [[1.0, 2.0], [5.0]])
    assert mixed({"a": mono, "b": stereo}) == [(0, 2, [11.0, 21.0, 32.0, 42.0]), (1, 2, [5.0, 5.0])]
    other = mono.withColumn("audio", F.col("audio").withField("sample_rate", F.lit(44_100)))
    with pytest.raises(Exception, match="different rates"):
        mixed({"a": mono, "b": other})
    with pytest.raises(ValueError, match="inputs"):
        mixed({"a": mono}, num_inputs=2)


def test_mixer_waits_for_every_input(spark):
    late = audio(spark, [[7.0], [8.0]], "t").withColumn("seq", F.col("seq") + 2)
    early = audio(spark, [[1.0], [2.0], [3.0]])
    # At 2 the latest frame of each is there; what came before is overwritten.
    assert mixed({"a": early, "b": late}) == [(2, 1, [10.0]), (3, 1, [8.0])]
    late_only = audio(spark, [[1.0], [2.0]])
    assert mixed({"a": late_only, "b": late.where("seq > 2")}) == [(3, 1, [10.0])]
    nothing = audio(spark, [[1.0]]).where("seq < 0")
    assert mixed({"a": early, "b": nothing}, sync_timeout_ms=None) == []
    assert len(mixed({"a": early, "b": nothing})) == 3


def test_text_of_bytes(spark):
    rows = lambda data: steps(audio(spark, [[0.0]]).withColumn("kind", F.lit("Binary")).withColumn("binary", F.struct(F.lit(bytearray(data)).alias("data"), F.lit(None).cast("string").alias("content_type"))), ("core::text_chunker", {}))
    assert [r.text for r in rows("Grüße an alle. Und mehr".encode()).orderBy("seq").collect()] == ["Grüße an alle.", "Und mehr"]
    with pytest.raises(Exception, match="UTF"):
        rows(b"\xff\xfe bad. ").collect()


def test_settings_of_audio_nodes(spark):
    from tidegate.plans import media  # noqa: F401

    a = audio(spark, [[0.1] * 480])
    for params in ({"target_sample_rate": 0, "chunk_frames": 1}, {"target_sample_rate": 8000, "chunk_frames": 0}, {"target_sample_rate": 8000, "chunk_frames": 1, "output_frame_size": 100}):
        with pytest.raises(ValueError):
            steps(a, ("audio::resampler", params))
    same = steps(a, ("audio::resampler", {"target_sample_rate": 48_000, "chunk_frames": 480, "output_frame_size": 240})).orderBy("seq").collect()
    assert [len(r.audio.samples) for r in same] == [240, 240] and same[0].audio.samples[0] == pytest.approx(0.1)
    two = a.unionByName(audio(spark, [[0.0]]).withColumn("seq", F.lit(9).cast("long")).withColumn("audio", F.col("audio").withField("sample_rate", F.lit(8000))))
    with pytest.raises(Exception, match="format of a stream changes"):
        steps(two, ("audio::resampler", {"target_sample_rate": 16_000, "chunk_frames": 480})).collect()
    with pytest.raises(ValueError, match="both or neither"):
        steps(a, ("audio::pacer", {"initial_channels": 1}))
    with pytest.raises(ValueError, match="buffer_size"):
        steps(a, ("core::pacer", {"buffer_size": 0}))


def test_paced_audio_is_filled_with_silence(spark):
    from tidegate.plans import media

    a = audio(spark, [[0.5] * 960, [0.5] * 960]).withColumn("metadata", media.timing(F.col("seq") * 100_000, F.lit(None), F.col("seq")))
    out = steps(a, ("audio::pacer", {"gap_ms": 50})).orderBy("metadata.timestamp_us").collect()
    assert [r.metadata.timestamp_us for r in out] == [0, 20_000, 40_000, 60_000, 80_000, 100_000]
    assert [max(r.audio.samples) for r in out] == [0.5, 0, 0, 0, 0, 0.5] and {len(r.audio.samples) for r in out} == {960}
    assert steps(a, ("audio::pacer", {"gap_ms": 50, "generate_silence": False})).count() == 2


def test_files_of_streams(spark, tmp_path):
    rows = spark.createDataFrame([("a", k, f"part {k} ") for k in range(30)] + [("b", 0, None)], "s string, n long, t string")
    packets_ = text_packets(rows, F.col("s"), F.col("n"), F.col("t")).withColumn("kind", F.when(F.col("text").isNotNull(), "Binary").otherwise("Text")).withColumn("binary", F.when(F.col("text").isNotNull(), F.struct(F.encode("text", "UTF-8").alias("data"), F.lit(None).cast("string").alias("content_type"))))
    out = steps(packets_, ("core::file_writer", {"path": str(tmp_path / "out")}), output="written")
    got = {r.stream_id: r for r in out.collect()}
    assert (got["a"].n_bytes, got["a"].discarded, got["b"].n_bytes, got["b"].discarded) == (len("".join(f"part {k} " for k in range(30))), 0, 0, 1)
    back = spark.read.parquet(str(tmp_path / "out")).where("stream = 'a'").orderBy("seq").collect()
    assert b"".join(bytes(r.data) for r in back).decode() == "".join(f"part {k} " for k in range(30))


def test_telemetry_of_all_kinds(spark):
    said = F.struct(F.lit("x" * 120).alias("text"), F.array(F.struct(F.lit("a").alias("text"), F.lit(0).cast("long").alias("start_time_ms"), F.lit(9).cast("long").alias("end_time_ms"), F.lit(0.5).cast("float").alias("confidence"))).alias("segments"), F.lit("en").alias("language"))
    one = audio(spark, [[3.0, -4.0]]).withColumn("metadata", F.struct(F.lit(5_000_000).cast("long").alias("timestamp_us"), F.lit(None).cast("long").alias("duration_us"), F.lit(0).cast("long").alias("sequence")))
    rows = one.unionByName(one.withColumn("kind", F.lit("Transcription")).withColumn("transcription", said).withColumn("seq", F.lit(1).cast("long")))
    every = ["Audio", "Transcription", "Custom", "Text", "Binary"]
    tap = {r.event_type: r.data for r in steps(rows, ("core::telemetry_tap", {"packet_types": every}), output="telemetry").collect()}
    assert tap["audio.level"] == '{"event_type":"audio.level","rms":3.5355339059327378,"peak":4.0,"sample_count":2,"sample_rate":48000,"channels":1}'
    assert tap["stt.result"].startswith('{"text_preview":"' + "x" * 100 + '...","segment_count":1,"segments":[{') and tap["stt.result"].endswith('"event_type":"stt.result"}')
    out = {r.event_type: r.data for r in steps(rows, ("core::telemetry_out", {"packet_types": every}), output="telemetry").collect()}
    assert set(out) == {"stt.result"} and '"text_length":120,"language":"en"' in out["stt.result"].replace('"segment_count":1,', "")
    many = rows.where("kind = 'Transcription'").withColumn("seq", F.explode(F.expr("sequence(0L, 9L)")))
    assert steps(many, ("core::telemetry_out", {"max_events_per_sec": 3}), output="telemetry").count() == 3


def test_best_effort_connections_drop(spark):
    from tidegate.plans import media
    from tidegate.plans.compiler import unread

    a = audio(spark, [[0.0]] * 6).withColumn("metadata", media.timing(F.floor(F.col("seq") / 3), F.lit(None), F.lit(None)))
    spec = {"nodes": {"a": {"kind": "io::input"}, "b": {"kind": "io::output", "needs": {"node": "a", "mode": "best_effort"}}, "c": {"kind": "io::output", "needs": "a"}}}
    p = compile_pipeline(spec)
    got = build(p, REGISTRY, {"a": a}, capacity=2)
    assert sorted(r.seq for r in got["b"].collect()) == [0, 1, 3, 4] and got["c"].count() == 6
    assert build(p, REGISTRY, {"a": a})["b"].count() == 6
    assert unread(p, REGISTRY) == ["b.out", "c.out"]


def test_voice_settings():
    from tidegate.plans.models import Shared, VadParams

    assert VadParams().updated(output_mode="filtered_audio").output_mode == "filtered_audio"
    for bad in ({"threshold": 1.5}, {"min_silence_duration_s": -1.0}, {"window_size": 0}, {"output_mode": "odd"}):
        with pytest.raises(ValueError):
            VadParams(**bad)
    with pytest.raises(ValueError, match="can't change"):
        VadParams().updated(threshold=0.7)
    made, shut = [], []
    shared = Shared(lambda p: made.append(p) or p, shut.append)
    assert shared.get(model="a", threads=2) is shared.get(threads=2, model="a") and shared.get(model="b")
    shared.close()
    assert len(made) == len(shut) == 2


def test_transcribers_refuse_other_audio(spark):
    from tidegate.plans import models
    from tidegate.plans.registry import Registry

    own = Registry()
    own.kinds.update(REGISTRY.kinds)
    models.speech_to_text("plugin::stt", None, lambda x: "", own)
    p = compile_pipeline({"steps": [{"kind": "io::input"}, {"kind": "plugin::stt"}]})
    with pytest.raises(Exception, match="16 kHz mono"):
        build(p, own, {"step_0": audio(spark, [[0.0] * 600])})["step_1"].collect()


def test_plugin(spark):
    def upper(frames, mark="!"):
        for pdf in frames:
            yield pdf.assign(text=pdf["text"].str.upper() + mark)

    plugin("plugin::upper", upper, "stream_id string, seq long, kind string, text string", {"mark": "!"})
    text = text_packets(spark.createDataFrame([(1, "hi")], "n long, t string"), F.lit("s"), F.col("n"), F.col("t")).select("stream_id", "seq", "kind", "text")
    out = build(compile_pipeline({"steps": [{"kind": "io::input"}, {"kind": "plugin::upper", "params": {"mark": "?"}}]}), REGISTRY, {"step_0": text})
    assert out["step_1"].first().text == "HI?"
    REGISTRY.unregister("plugin::upper")


def test_identity_chain_leaves_no_plan(spark):
    a = audio(spark, [[0.5]])
    out = build(compile_pipeline({"steps": [{"kind": "io::input"}, *[{"kind": "core::passthrough"}] * 16]}), REGISTRY, {"step_0": a})
    assert out["step_16"]._jdf.queryExecution().toString() == a._jdf.queryExecution().toString()


def test_session(spark, tmp_path):
    a = audio(spark, [[0.25], [0.5]])
    a.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(a.schema).parquet(str(tmp_path / "in"))
    p = compile_pipeline({"name": "doubling", "steps": [{"kind": "io::input"}, {"kind": "audio::gain", "params": {"gain": 2.0}}]})
    sessions = Sessions(REGISTRY)
    session = sessions.start(p, {"step_0": stream}, str(tmp_path / "ck"))
    with pytest.raises(ValueError):
        sessions.start(p, {"step_0": stream}, str(tmp_path / "ck"))
    session.drain()
    assert session.stats()["step_1"]["state"] == "Running"
    assert sorted(r.audio.samples[0] for r in spark.table("doubling_step_1").collect()) == [0.5, 1.0]
    sessions.stop("doubling")
    assert not sessions.running


def test_a_running_session_changes(spark, tmp_path):
    a = audio(spark, [[0.25], [0.5]])
    a.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(a.schema).parquet(str(tmp_path / "in"))
    sessions = Sessions(REGISTRY)
    p = compile_pipeline({"name": "live", "nodes": {"src": {"kind": "io::input"}, "g": {"kind": "audio::gain", "needs": "src", "params": {"gain": 2.0}}}})
    session = sessions.start(p, {"src": stream}, str(tmp_path / "ck"))
    value = lambda table: sorted(r.audio.samples[0] for r in spark.table(table).collect())
    session.drain()
    assert value("live_g") == [0.5, 1.0]
    # A table in memory begins anew.
    sessions.tune("live", "g", gain=4.0)
    session.drain()
    assert value("live_g") == [1.0, 2.0]
    with pytest.raises(ValueError, match="gain"):
        sessions.tune("live", "g", gain=9.0)
    assert session.stats()["g"]["state"] == "Running"  # what doesn't compile changes nothing
    sessions.add("live", "h", "audio::gain", {"gain": 0.5}, ["src"])
    session.drain()
    assert value("live_h") == [0.125, 0.25]
    with pytest.raises(ValueError, match="exists"):
        sessions.add("live", "h", "audio::gain")
    # An output that reads from other nodes than before begins anew.
    sessions.add("live", "i", "audio::gain", {"gain": 3.0}, ["g"])
    session.drain()
    assert value("live_i") == [3.0, 6.0] and set(session.queries) == {"h", "i"}
    sessions.disconnect("live", "g", "i")
    sessions.add("live", "j", "audio::gain", {"gain": 1.0}, ["h"])
    session.drain()
    assert value("live_j") == [0.125, 0.25] and set(session.queries) == {"g", "j"}
    sessions.remove("live", "h")
    assert set(session.pipeline.nodes) == {"src", "g"} and set(session.queries) == {"g"}
    assert {e["event"] for e in session.events()} == {"node_state_changed", "node_stats_updated"}
    sessions.stop("live", grace=True)
    assert not sessions.running


def test_a_tuned_node_goes_on_from_its_checkpoint(spark, tmp_path):
    """Only what is new gets the new gain."""
    a = audio(spark, [[0.25], [0.5]])
    a.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(a.schema).parquet(str(tmp_path / "in"))
    sessions = Sessions(REGISTRY)
    session = sessions.start(compile_pipeline({"name": "kept", "steps": [{"kind": "io::input"}, {"kind": "audio::gain", "params": {"gain": 2.0}}]}), {"step_0": stream}, str(tmp_path / "ck"), sink="parquet")
    session.drain()
    sessions.tune("kept", "step_1", gain=4.0)
    audio(spark, [[1.0]]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    session.drain()
    assert sorted(r.audio.samples[0] for r in spark.read.parquet(str(tmp_path / "ck" / "kept_step_1-0-rows")).collect()) == [0.5, 1.0, 4.0]
    sessions.stop("kept")


def test_a_failed_query_recovers(spark, tmp_path):
    a = audio(spark, [[0.25]])
    a.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(a.schema).parquet(str(tmp_path / "in"))
    broken = tmp_path / "broken"
    broken.write_text("")

    def once(frames):
        import os

        for pdf in frames:
            if os.path.exists(broken):
                raise RuntimeError("not yet")
            yield pdf[["stream_id", "seq", "kind"]]

    broken = str(broken)
    plugin("plugin::once", once, "stream_id string, seq long, kind string")
    sessions = Sessions(REGISTRY)
    session = sessions.start(compile_pipeline({"name": "flaky", "steps": [{"kind": "io::input"}, {"kind": "plugin::once"}]}), {"step_0": stream}, str(tmp_path / "ck"), profile="low_latency")
    with pytest.raises(Exception, match="not yet"):
        session.queries["step_1"].awaitTermination(60)
    assert session.stats()["step_1"]["state"] == "Failed"
    (tmp_path / "broken").unlink()
    assert sessions.recover("flaky", wait=0.1) == ["step_1"] and session.failures == {"step_1": 1}
    session.drain()
    assert spark.table("flaky_step_1").count() == 1 and sessions.recover("flaky") == []
    sessions.stop("flaky")
    REGISTRY.unregister("plugin::once")


def test_fetched_bodies(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from tidegate.plans import media

    class Pages(BaseHTTPRequestHandler):
        def do_GET(self):
            moved = self.path == "/moved"
            self.send_response(302 if moved else 404 if self.path == "/none" else 200)
            self.send_header("Location" if moved else "Content-Type", "/page" if moved else "text/plain")
            self.end_headers()
            self.wfile.write(b"x" * 20_000 if self.path == "/page" else b"")

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    try:
        fetch = lambda url, **p: build(compile_pipeline({"steps": [{"kind": "transport::http::fetcher", "params": {"url": url, **p}}]}), REGISTRY)["step_0"]
        got = fetch(f"{at}/page").orderBy("seq").collect()
        assert [len(r.binary.data) for r in got] == [8192, 8192, 3616] and got[0].binary.content_type == "text/plain"
        for path in ("/none", "/moved"):
            with pytest.raises(ValueError, match="status"):
                media.http_get(at + path)
        with pytest.raises(ValueError, match="chunk_size"):
            fetch(f"{at}/page", chunk_size=0)
    finally:
        server.shutdown()


def webm_elements(data, inside=("Segment", "Cluster", "Tracks", "TrackEntry", "Audio")):
    """(name, body) of a stream's elements, those with others in them opened."""
    from tidegate.sources.webm import ELEMENTS

    names, out, at = {v: k for k, v in ELEMENTS.items()}, [], 0
    while at < len(data):
        n = 8 - data[at].bit_length() + 1
        name = names[int.from_bytes(data[at : at + n], "big")]
        size = int.from_bytes(data[at + n : at + n + 8], "big") & ((1 << 56) - 1)
        at += n + 8
        if name in inside:
            out.append((name, None))
            continue
        out.append((name, data[at : at + size]))
        at += size
    return out


def test_webm(spark):
    from tidegate.plans import media

    rows = spark.createDataFrame([("s", k, f"packet {k}") for k in range(5)], "s string, n long, t string")
    p = text_packets(rows, F.col("s"), F.col("n"), F.col("t")).withColumn("kind", F.lit("Binary")).withColumn("binary", F.struct(F.encode("text", "UTF-8").alias("data"), F.lit(None).cast("string").alias("content_type")))
    p = p.withColumn("metadata", media.timing(F.when(F.col("seq") == 3, 100_000), F.lit(20_000), F.col("seq")))
    live = steps(p, ("containers::webm::muxer", {"channels": 2})).orderBy("seq").collect()
    whole = steps(p, ("containers::webm::muxer", {"channels": 2, "streaming_mode": "file"})).collect()
    data = b"".join(bytes(r.binary.data) for r in live)
    assert len(live) == 5 and len(whole) == 1 and bytes(whole[0].binary.data) == data and live[0].binary.content_type == 'audio/webm; codecs="opus"'
    got = webm_elements(data)
    assert [b for n, b in got if n == "CodecID"] == [b"A_OPUS"] and [b[-1] for n, b in got if n == "Channels"] == [2]
    assert [int.from_bytes(b, "big") for n, b in got if n == "Timecode"] == [20, 40, 60, 100, 120]
    assert [b[4:].decode() for n, b in got if n == "SimpleBlock"] == [f"packet {k}" for k in range(5)]
    for bad in ({"channels": 3}, {"streaming_mode": "odd"}):
        with pytest.raises(ValueError):
            steps(p, ("containers::webm::muxer", bad))
