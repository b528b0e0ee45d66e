"""Packet functions and operators on small fixtures."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidegate.functions import filters, frames, packets, text
from tidegate.operators import activity, chunker, clocks, fanin, ordering, stats, telemetry
from tidegate.sources import files


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def arr(*x):
    return F.array(*(F.lit(float(v)) for v in x)).cast("array<float>")


def test_frames(spark):
    r = one(spark, frames.rms(arr(0.5, -0.5, 0.5, -0.5)), frames.rms(arr()), frames.peak(arr(0.1, -0.8, 0.3, -0.2)), frames.peak(arr()))
    assert r[0] == pytest.approx(0.5) and r[1] == 0 and r[2] == pytest.approx(0.8) and r[3] == 0
    mixed = one(spark, frames.mix(arr(0.1, 0.5), arr(0.2)), frames.mix(F.lit(None).cast("array<float>"), arr(1)), frames.mix(arr(0.5), arr(-0.3)))
    assert list(mixed[0]) == pytest.approx([0.3, 0.5]) and list(mixed[1]) == [1.0] and list(mixed[2]) == pytest.approx([0.2])
    c = one(spark, frames.convert(arr(1, 2), 1, 2), frames.convert(arr(1, 3, 5, 7), 2, 1), frames.convert(arr(1, 2), 2, 3), frames.convert(arr(), 1, 2))
    assert [list(x) for x in c] == [[1, 1, 2, 2], [2, 6], [1, 2, 1], []]
    d = one(spark, frames.num_frames(arr(1, 2, 3), F.lit(0)), frames.num_frames(arr(1, 2, 3, 4), F.lit(2)), frames.duration_us(arr(1, 2), F.lit(1), F.lit(0)), frames.pad(arr(1), 3))
    assert (d[0], d[1], d[2], list(d[3])) == (0, 2, None, [1, 0, 0])
    for bad in (-0.1, 4.1, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            frames.check_gain(bad)
    assert frames.db_gain(20) == pytest.approx(10)


def test_text(spark):
    t = F.lit
    r = one(spark, text.preview(t("é" * 5), 3), text.preview(t("abc"), 3), text.preview(t("abc"), 0), text.redact(t("éé"), 3), text.redact(t("abcd"), 3))
    assert list(r) == ["ééé...", "abc", "", "éé...[truncated]", "abc...[truncated]"]
    s = one(spark, text.sanitize(t("Hé  llo* wörld")), text.sanitize(t("Hé!"), "ascii"), text.sanitize(t("你好。*"), "cjk"), text.sanitize(t("  ")))
    assert list(s) == ["Hé llo wörld.", "H!", "你好。", ""]
    g = lambda x, *p: one(spark, text.glob_any(t(x), list(p)))[0]
    assert g("vad.start", "vad.*") and g("vadfoo", "vad.*") and g("stt.result", "vad.*", "stt.result") and not g("llm.response", "vad.*", "stt.result") and g("x")
    deep = spark.createDataFrame([('{"a": "xxxxxx", "b": [{"c": "yyyyyy"}, 1]}',)], "s string").select(text.redact_json(3)("s")).first()[0]
    assert deep == '{"a":"xxx...[truncated]","b":[{"c":"yyy...[truncated]"},1]}'


def test_tagged_json_keeps_nulls(spark):
    body = F.struct(F.lit("a").alias("text"), F.lit(None).cast("string").alias("language"))
    r = one(spark, packets.to_tagged_json(F.lit("Transcription"), body), packets.to_tagged_json(F.lit("Text"), F.lit('q"x'), newline=True))
    assert list(r) == ['{"Transcription":{"text":"a","language":null}}', '{"Text":"q\\"x"}\n']


@pytest.mark.parametrize(
    "mode,texts,want",
    [
        ("sentences", ["Hello world. How are you?"], ["Hello world.", "How are you?"]),
        ("sentences", ["A first one! B. C is here"], ["A first one! B.", "C is here"]),
        ("sentences", ["Hello wor", "ld. Fine", " day. "], ["Hello world.", "Fine day."]),
        ("sentences", ["Hi."], ["Hi."]),
        ("sentences", ["", None, "short"], ["short"]),
        ("clauses", ["One thing, two things; three"], ["One thing,", "two things;", "three"]),
        ("words", ["a b c d e f g"], ["a b c d e", "f g"]),
        ("words", ["a  b c d e f g"], ["a  b c d", "e f g"]),
        ("words", ["a b c d e"], ["a b c d e"]),
    ],
)
def test_chunker(spark, mode, texts, want):
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "s long, seq long, text string")
    got = chunker.chunks(rows, "s", ["seq"], "text", mode, min_length=10).orderBy("chunk_no").collect()
    assert [r.chunk for r in got] == want


def test_chunker_waits_for_enough_bytes():
    assert chunker.Chunker(min_length=20).feed("", "Hi. You. ") == ("Hi. You. ", [])
    with pytest.raises(ValueError):
        chunker.Chunker("lines")


def test_running_total_and_eviction(spark):
    rows = spark.createDataFrame([(i, float(i * 7 % 50), i % 5 + 1) for i in range(300)], "id long, used double, size int")
    got = ordering.running_total(rows, "used", F.col("size"), "total", "id", buckets=7).toPandas().sort_values(["used", "id"])
    assert (got["total"].to_numpy() == got["size"].cumsum().to_numpy()).all()
    freed = stats.evict(rows, "used", "id", "size", 20).toPandas()
    assert freed["freed"].max() >= 20 > freed["freed"].sort_values().iloc[-2]
    assert ordering.running_total(rows.limit(0), "used", F.col("size"), "total", "id").count() == 0


def test_rechunk_and_resample(spark):
    rows = spark.createDataFrame([(1, k, [float(k * 4 + i) for i in range(4)]) for k in range(5)], "s long, seq long, x array<float>")
    got = ordering.rechunk(rows, "s", "seq", "x", 6).orderBy("chunk").collect()
    assert [list(r.x) for r in got] == [[float(v) for v in range(a, min(a + 6, 20))] for a in range(0, 20, 6)]
    up = clocks.resample(rows, "s", "seq", "x", 1, 2).orderBy("k").collect()
    assert [r.value for r in up] == [min(k / 2, 19) for k in range(40)]


def test_clocks(spark):
    rows = spark.createDataFrame([(1, 0, None, None), (1, 1, None, 10_000), (1, 2, 1_000_000, None), (1, 3, None, 20_000)], "s long, seq long, ts long, d long")
    got = clocks.granule(rows, "s", ["seq"], F.col("ts"), F.col("d")).orderBy("seq").collect()
    assert [r.granule for r in got] == [0, 480, 48_000, 48_960]
    web = clocks.webm_clock(rows, "s", ["seq"], F.col("ts"), F.col("d"), F.lit(True)).orderBy("seq").collect()
    assert [r.timestamp_ns for r in web] == [20_000_000, 30_000_000, 1_000_000_000, 1_020_000_000]
    moq = clocks.media_clock(rows, "s", ["seq"], F.col("d"), 5, 40).orderBy("seq").collect()
    assert [(r.media_ms, r.keyframe) for r in moq] == [(5, True), (25, False), (35, False), (55, False)]
    with pytest.raises(ValueError):
        clocks.pace(rows, "s", ["seq"], F.col("ts"), F.col("d"), 0, 3, 1)
    arrivals = spark.createDataFrame([(1, 0, 0), (1, 1, 10), (1, 2, 20), (1, 3, 5000)], "s long, seq long, t long")
    paced = clocks.pace(arrivals, "s", ["seq"], F.col("t"), F.lit(100), 1.0, 1, 300).orderBy("seq").collect()
    assert [(r.segment, r.release_us) for r in paced] == [(1, 0), (1, 10), (1, 110), (2, 5000)]


def test_mixing_in_time(spark):
    rows = spark.createDataFrame([("a", 0, 1.0), ("a", 0, 2.0), ("b", 0, 5.0), ("a", 3, 4.0)], "pin string, tick long, v double")
    got = fanin.clocked(rows, "tick", ["a", "b"], 1, [F.col("v").desc()], F.col("v")).orderBy("tick").collect()
    assert [(r.mixed, r.pins) for r in got] == [(7.0, 2), (0.0, 0), (0.0, 0), (4.0, 1)]


def test_rate_limit_lets_one_through_when_none_may_pass(spark):
    rows = spark.createDataFrame([(1, t, t) for t in (0, 1, 2, 10, 11)], "k long, t long, id long")
    some = telemetry.rate_limited(rows, ["k"], "t", "id", 10, 2).orderBy("t").collect()
    assert [r.allowed for r in some] == [True, True, False, True, True]
    none = telemetry.rate_limited(rows, ["k"], "t", "id", 10, 0).orderBy("t").collect()
    assert [r.allowed for r in none] == [True, False, False, True, False]
    assert telemetry.drop_health(telemetry.rate_limited(rows, ["k"], "t", "id", 10, 0), ["k"]).first().dropped == 3


def test_speech(spark):
    marks = [(1, t, t in (1, 2, 5)) for t in range(8)]
    rows = spark.createDataFrame(marks, "s long, t long, v boolean")
    got = activity.speech_events(rows, "s", ["t"], F.col("t"), F.col("v")).orderBy("at_us").collect()
    assert [(r.at_us, r.event_type, r.duration_us) for r in got] == [(1, "speech_start", None), (3, "speech_end", 2), (5, "speech_start", None), (6, "speech_end", 1)]
    seg = activity.segments_with_limit(rows.withColumn("id", F.col("t")), "s", "t", "id", "v", 3, 1000).collect()
    assert [(r.start_us, r.end_us, r.windows) for r in seg] == [(1, 5, 3)]


def test_reports(spark):
    rows = spark.createDataFrame([("a", float(i), i % 10 != 0) for i in range(1, 101)], "op string, v double, ok boolean")
    r = stats.report(rows, ["op"], "v", F.col("ok")).first()
    ok = sorted(i for i in range(1, 101) if i % 10)
    assert (r.total, r.succeeded, r.p50, r.p95, r.p99) == (100, 90, ok[44], ok[85], ok[89])
    assert stats.report(rows, ["op"], "v", F.col("ok"), exact=False).first().p50 == ok[44]
    states = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b")], "k long, t long, s string")
    assert [(r.state, r.gauge) for r in stats.one_hot(states, "k", ["t"], "s").orderBy("t", "gauge").collect()] == [("a", 1), ("a", 0), ("b", 1)]


def test_ranks_of_many_values(spark, tmp_path):
    import random

    rnd = random.Random(6)
    rows = [(k, rnd.choice([rnd.random(), 0.5, None])) for k in "abc" for _ in range(700)] + [("one", 3.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    got = {r.k: (r.p1, r.p50, r.p99, r.p100) for r in stats.ranks(df, ["k"], "v", [1, 50, 99, 100], ranges=8).collect()}
    want = {}
    for k in ("a", "b", "c", "one", "none"):
        own = sorted(v for g, v in rows if g == k and v is not None)
        want[k] = tuple(own[-(-p * len(own) // 100) - 1] if own else None for p in (1, 50, 99, 100))
    assert got == want
    same = [stats.report(df, ["k"], "v", F.lit(True), spread=s).orderBy("k").collect() for s in (False, True)]
    assert same[0] == same[1] and stats.report(df, [], "v", F.lit(True), spread=True).collect() == stats.report(df, [], "v", F.lit(True)).collect()
    for form in ("json", "csv"):
        stats.write_report(stats.report(df, ["k"], "v", F.lit(True)), str(tmp_path / form), form)
        assert spark.read.option("header", True).format(form).load(str(tmp_path / form)).count() == 5
    with pytest.raises(ValueError):
        stats.write_report(df, "x", "xml")


def test_counters_of_large_streams(spark):
    rows = spark.range(3000).select((F.col("id") % 2).alias("node"), (F.col("id") * 7919 % 1000).alias("at"), "id", (F.col("id") % 3 == 0).alias("s"))
    got = ordering.range_totals(rows, ["node"], "at", "id", {"all": F.lit(1), "some": F.col("s").cast("int")}, parts=9).toPandas().sort_values(["node", "at", "id"])
    assert (got["all"].to_numpy() == got.groupby("node").cumcount().to_numpy() + 1).all()
    assert (got["some"].to_numpy() == got["s"].astype(int).groupby(got["node"]).cumsum().to_numpy()).all()
    one = ordering.range_totals(rows.where("at = 0"), ["node"], "at", "id", {"all": F.lit(1)})
    assert one.count() == 3 and ordering.range_totals(rows.limit(0), ["node"], "at", "id", {"all": F.lit(1)}).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(bytes(range(200)) * 100)
    (tmp_path / "empty.bin").write_bytes(b"")
    got = files.read_binary(spark, str(tmp_path), 8192).orderBy("chunk_no").collect()
    assert [len(r.data) for r in got] == [8192, 8192, 3616] and b"".join(bytes(r.data) for r in got) == bytes(range(200)) * 100
    assert files.written_blocks([10, 10, 10, 8], 10) == [10, 10, 10, 8] and files.written_blocks([6, 6, 1], 10) == [12, 1]
    wav = files.make_wav(16_000, 2, [0.0, 0.5, -0.5, 1.0])
    rate, channels, x = files.parse_wav(wav)
    assert (rate, channels) == (16_000, 2) and list(x) == pytest.approx([0, 0.5, -0.5, 1.0], abs=1e-4)
    rows = spark.createDataFrame([("a", files.make_wav(8000, 1, [0.1] * 2000)), ("b", b"RIFF"), ("c", None)], "name string, data binary")
    out = {(r.name, r.seq): r for r in files.wav_frames(rows, "name", "data").collect()}
    assert len(out["a", 0].samples) == 1920 and len(out["a", 1].samples) == 80 and out["b", 0].error and out["c", 0].error


def test_spans_and_as_of(spark):
    rows = spark.createDataFrame([(1, 1, 1, "s"), (1, 2, 2, "e"), (1, 5, 3, "e"), (2, 1, 4, "e")], "k long, at long, id long, kind string")
    got = telemetry.spans(rows, "k", ["at"], F.col("at"), F.col("kind") == "s", F.col("kind") == "e").orderBy("id").collect()
    assert [(r.id, r.latency_us) for r in got] == [(2, 1), (3, 4)]
    controls = spark.createDataFrame([(1, 2, 0.5)], "k long, at long, gain double")
    found = telemetry.latest_before(rows.select("k", "at", "id"), controls, "k", "at", "id", "gain").orderBy("id").collect()
    assert [r.current for r in found] == [None, 0.5, 0.5, None]
    env = one(spark, telemetry.map_envelope(F.create_map(F.lit("a"), F.lit("b")), "x.y", F.lit("7")))[0]
    assert env == '{"a":"b","event_type":"x.y","correlation_id":"7"}'
    wrapped = one(spark, *(telemetry.envelope(F.lit(v), "x.y", turn=F.lit("t")) for v in ("[1, 2]", "3", " {} ", '{"a": {"b": "}"}}')))
    assert list(wrapped) == ['{"value":[1, 2],"event_type":"x.y","turn_id":"t"}', '{"value":3,"event_type":"x.y","turn_id":"t"}', '{"event_type":"x.y","turn_id":"t"}', '{"a": {"b": "}"},"event_type":"x.y","turn_id":"t"}']


def test_paths_and_kinds(spark):
    may = lambda path, *rules: one(spark, filters.read_allowed(F.lit(path), list(rules), "/srv"), filters.write_allowed(F.lit(path), list(rules), "/srv"))
    assert list(may("a/b.txt", "a/*")) == [True, True] and list(may("a/../c", "a/*")) == [False, False] and list(may("a/../a/c", "a/*")) == [True, False]
    assert list(may("/etc/passwd", "a/*")) == [False, False] and list(may("../../../x", "/x")) == [True, False] and list(may("a/b")) == [False, False]
    rows = spark.createDataFrame([("s", 1, "Text"), ("s", 2, "Audio"), ("s", 3, None)], "stream_id string, seq long, kind string")
    kept = lambda policy: sorted((r.seq, r.handled) for r in filters.admit(rows, ["text"], policy).collect())
    assert kept("ignore") == kept("discard") == [(1, True)] and kept("forward") == [(1, True), (2, False), (3, False)]
    with pytest.raises(Exception, match="unexpected packet of kind"):
        kept("error")
    with pytest.raises(ValueError):
        kept("odd")
    assert tuple(filters.discards(rows, ["Text"]).first()) == ("s", 3, 2)


def test_session_names(spark):
    def plain(text):
        h = filters.OFFSET
        for b in text.encode():
            h = (h ^ b) * filters.PRIME % (1 << 64)
        return f"{filters.ADJECTIVES[h % 21]}-{filters.NOUNS[(h >> 8) % 22]}-{(h >> 16) & 0xFFFF:04x}"

    for text in ("", "a", "session-1", "é" * 40, "3f2c9f0e-77aa"):
        assert one(spark, filters.session_name(F.lit(text)))[0] == plain(text)


def test_translator_settings():
    text.check_languages("en", "es", 512)
    for bad in (("en", "en", 512), ("de", "es", 512), ("en", "fr", 512), ("en", "es", 31), ("en", "es", 2049)):
        with pytest.raises(ValueError):
            text.check_languages(*bad)


def test_blanks_and_tags(spark):
    r = one(spark, text.blank(F.lit("\t\u00a0\u2003\n")), text.blank(F.lit(" x ")), text.translated(F.lit("\u2003<unk> hi\n")), text.language_tag(F.lit("<|en|><|NEUTRAL|> hi"), F.lit("auto")), text.language_tag(F.lit("<|en|> hi"), F.lit("de")), text.without_tags(F.lit("<|en|><|NEUTRAL|> hi ")))
    assert list(r) == [True, False, "hi", "en", "de", "hi"]


def test_slow_inputs(spark):
    rows = spark.createDataFrame([("a", t) for t in (1, 2, 5)] + [("b", t) for t in (2, 3, 5)], "pin string, tick long")
    got = sorted((r.pin, r.tick, r.change) for r in fanin.slow_inputs(rows, ["a", "b"]).collect())
    assert got == [("a", 3, "slow"), ("a", 5, "recovered")]


def test_ogg_pages():
    import random

    from tidegate.sources import ogg

    rnd = random.Random(3)
    sizes = [1, 254, 255, 256, 510, 255 * 255 - 1, 255 * 255, 255 * 255 + 1, 150_000, 7]
    sent = [bytes(rnd.randrange(256) for _ in range(n)) for n in sizes]
    data, number = b"", 0
    for k, p in enumerate(sent):
        page, number = ogg.pages(p, 9, number, 960 * k, ogg.BEGINS if k == 0 else 0)
        data += page
    for step in (1, 37, 4096, len(data)):
        if step == 1 and len(data) > 10_000:
            continue
        reader = ogg.PageReader()
        got = [x for i in range(0, len(data), step) for x in reader.feed(data[i : i + step])]
        assert [p for p, _ in got] == sent and [g for _, g in got] == [960 * k for k in range(len(sent))]
    broken = bytearray(data)
    broken[40] ^= 1  # in the second page: its packet is lost, the others aren't
    assert len(ogg.PageReader().feed(bytes(broken))) == len(sent) - 1
    # A known value: the check sum of a page with these nine characters.
    assert ogg.checksum(b"123456789") == 0x89A1897F


def test_runs_hold_state_across_batches(spark):
    rows = spark.range(5000).select((F.col("id") % 2).alias("k"), F.col("id").alias("t"), F.col("id").alias("id"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "300")
    try:
        got = telemetry.rate_limited(rows, ["k"], "t", "id", 100, 7).orderBy("t").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, state = [], {}
    for t in range(5000):
        start, n = state.get(t % 2, (None, 0))
        if start is None or t - start >= 100:
            start, n, ok = t, 1, True
        else:
            ok = n < 7
            n += ok
        state[t % 2] = start, n
        want.append(ok)
    assert [r.allowed for r in got] == want


def test_filters(spark):
    ok = lambda url, *rules: one(spark, filters.url_allowed(F.lit(url), list(rules)))[0]
    assert ok("https://a.com/x/y", "https://a.com/x/*") and ok("https://a.com:81/x", "https://a.com/*") and ok("https://a.com:81/x", "https://a.com:81/*")
    assert not ok("http://a.com/x", "https://a.com/*") and not ok("https://a.com:80/x", "https://a.com:81/*") and not ok("https://b.com/x", "https://a.com/*") and not ok("https://a.com/x") and not ok("nonsense", "https://a.com/*")
    data = lambda b: one(spark, filters.audio_packet(F.lit(bytearray(b))))[0]
    assert data(b"x" * 10) and not data(b"x" * 9) and not data(b"OpusHead12345") and not data(b"OpusTags12345")
    step = lambda a, b: one(spark, filters.may_follow(F.lit(a).cast("string"), F.lit(b), filters.LIFECYCLE))[0]
    assert step("Ready", "Running") and step(None, "Ready") and not step("Stopped", "Running") and not step("Ready", "Ready")
    rows = spark.createDataFrame([(1, i, 0) for i in range(5)], "k long, t long, read long")
    assert [r.lost for r in telemetry.lagged(rows, "k", ["t"], F.col("read"), 3).orderBy("t").collect()] == [0, 0, 0, 1, 2]
