"""Queries over frames: each row of embeddings is a mono frame, its label the stream, its vec_id the order."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegate.catalogue.common import Catalogue, r6, table
from tidegate.functions import frames as fr
from tidegate.operators import clocks, fanin, ordering
from tidegate.plans.compiler import compile_pipeline, build
from tidegate.plans.nodes import REGISTRY
from tidegate.functions.packets import audio_packets

C = Catalogue()
QUERIES, ORACLE_SQL = C.queries, C.sql
EACH = "SELECT vec_id, label, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings"
NUMBERED = "SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS n FROM embeddings"


def embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "samples")


def exploded(df, *keep, samples="samples", name="value"):
    rows = df.select(*keep, F.posexplode(samples).alias("pos", "x"))
    return rows.select(*rows.columns[:-2], F.col("pos").cast("long").alias("pos"), r6(F.col("x")).alias(name))


def packets(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return audio_packets(e, F.col("label").cast("string"), F.col("vec_id"), F.col("samples"), 48_000)


@C.add(f"SELECT vec_id, pos, round(x * 2, 6) AS value FROM ({EACH})")
def gain_double(spark, sf_dir):
    """The smallest pipeline: input, gain of 2, output."""
    p = compile_pipeline({"steps": [{"kind": "io::input"}, {"kind": "audio::gain", "params": {"gain": 2.0}}, {"kind": "io::output"}]}, REGISTRY)
    (out,) = build(p, REGISTRY, {"step_0": packets(spark, sf_dir)}).values()
    return exploded(out, F.col("seq").alias("vec_id"), samples="audio.samples")


@C.add(f"SELECT vec_id, pos, round((x * power(10.0, 6.0 / 20.0))::FLOAT::DOUBLE, 6) AS value FROM ({EACH})")
def gain_db(spark, sf_dir):
    return exploded(embeddings(spark, sf_dir).withColumn("samples", fr.gain(F.col("samples"), F.lit(fr.db_gain(6.0)))), "vec_id")


@C.add(f"SELECT vec_id, pos, round((x * 1.5)::FLOAT::DOUBLE, 6) AS value FROM ({EACH})")
def gain_fused_chain(spark, sf_dir):
    """Eight gains in a row, which the compiler turns into one."""
    gains = [0.5, 2.0, 3.0, 0.5, 0.5, 2.0, 0.5, 2.0]
    p = compile_pipeline({"steps": [{"kind": "io::input"}, *({"kind": "audio::gain", "params": {"gain": g}} for g in gains)]}, REGISTRY)
    (out,) = build(p, REGISTRY, {"step_0": packets(spark, sf_dir)}).values()
    return exploded(out, F.col("seq").alias("vec_id"), samples="audio.samples")


@C.add("SELECT count(*) AS n_packets, sum(len(embedding))::BIGINT AS n_samples FROM embeddings")
def passthrough_chain(spark, sf_dir):
    """Sixteen identity nodes leave no trace in the plan."""
    p = compile_pipeline({"steps": [{"kind": "io::input"}, *[{"kind": "core::passthrough"}] * 16]}, REGISTRY)
    (out,) = build(p, REGISTRY, {"step_0": packets(spark, sf_dir)}).values()
    return out.agg(F.count("*").alias("n_packets"), F.sum(F.size("audio.samples")).alias("n_samples"))


@C.add("""SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding)), 6) AS rms,
       round(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))), 6) AS peak, len(embedding) AS sample_count FROM embeddings""")
def audio_level_frame(spark, sf_dir):
    return embeddings(spark, sf_dir).select("vec_id", r6(fr.rms(F.col("samples"))).alias("rms"), r6(fr.peak(F.col("samples"))).alias("peak"), F.size("samples").cast("long").alias("sample_count"))


@C.add(f"""WITH n AS ({NUMBERED}), e AS (SELECT label, n, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM n WHERE label IN (0, 1))
SELECT n, pos, round(sum(x)::FLOAT::DOUBLE, 6) AS value FROM e GROUP BY n, pos""")
def mix_two(spark, sf_dir):
    e = fanin.numbered(embeddings(spark, sf_dir), "label", "vec_id")
    mixed = fanin.mix_two(e.where("label = 0"), e.where("label = 1"))
    return exploded(mixed, F.col("n").cast("long").alias("n"))


@C.add(f"""WITH n AS ({NUMBERED}), e AS (SELECT label, n, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM n)
SELECT n, pos, round(sum(x), 6) AS value FROM e GROUP BY n, pos""")
def mix_many(spark, sf_dir):
    mixed = fanin.mix_many(fanin.numbered(embeddings(spark, sf_dir), "label", "vec_id"))
    return mixed.select(F.col("n").cast("long").alias("n"), F.col("pos").cast("long").alias("pos"), r6(F.col("value")).alias("value"))


@C.add(f"""WITH n AS ({NUMBERED}), s AS (SELECT max(n) AS m FROM n), t AS (SELECT unnest(range(m + 1)) AS n FROM s),
a AS (SELECT n, embedding FROM n WHERE label = 2 AND n % 3 <> 0), b AS (SELECT n, embedding FROM n WHERE label = 3)
SELECT t.n, (a.n IS NOT NULL)::BIGINT + (b.n IS NOT NULL)::BIGINT AS inputs,
       round(coalesce(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE)), 0) + coalesce(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE)), 0), 4) AS total
FROM t LEFT JOIN a ON a.n = t.n LEFT JOIN b ON b.n = t.n WHERE a.n IS NOT NULL OR b.n IS NOT NULL""")
def mix_missing_silence(spark, sf_dir):
    """Every third frame of one input is missing; silence takes its place."""
    e = fanin.numbered(embeddings(spark, sf_dir), "label", "vec_id")
    a, b = e.where("label = 2 and n % 3 <> 0").select("n", F.col("samples").alias("x")), e.where("label = 3").select("n", F.col("samples").alias("y"))
    both = a.join(b, "n", "full_outer")
    total = F.coalesce(fr.sum_of(F.col("x")), F.lit(0.0)) + F.coalesce(fr.sum_of(F.col("y")), F.lit(0.0))
    return both.select(F.col("n").cast("long").alias("n"), (F.col("x").isNotNull().cast("long") + F.col("y").isNotNull().cast("long")).alias("inputs"), F.round(total, 4).alias("total"))


@C.add(f"SELECT vec_id, 2 * pos + c AS pos, round(x, 6) AS value FROM ({EACH}), (VALUES (0), (1)) AS t(c)")
def mono_to_stereo(spark, sf_dir):
    return exploded(embeddings(spark, sf_dir).withColumn("samples", fr.convert(F.col("samples"), 1, 2)), "vec_id")


@C.add(f"""WITH e AS ({EACH}) SELECT a.vec_id, a.pos // 2 AS pos, round(((a.x::FLOAT + b.x::FLOAT) / 2)::FLOAT::DOUBLE, 6) AS value
FROM e a JOIN e b ON a.vec_id = b.vec_id AND b.pos = a.pos + 1 WHERE a.pos % 2 = 0""")
def stereo_to_mono(spark, sf_dir):
    return exploded(embeddings(spark, sf_dir).withColumn("samples", fr.convert(F.col("samples"), 2, 1)), "vec_id")


@C.add(f"""WITH e AS ({EACH}), t AS (SELECT unnest(range(3)) AS c)
SELECT e.vec_id, (e.pos // 2) * 3 + t.c AS pos, round(e.x, 6) AS value FROM e JOIN t ON t.c % 2 = e.pos % 2""")
def cyclic_channels(spark, sf_dir):
    """Two channels to three: the third repeats the first."""
    return exploded(embeddings(spark, sf_dir).withColumn("samples", fr.convert(F.col("samples"), 2, 3)), "vec_id")


@C.add("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, max(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber ROWS UNBOUNDED PRECEDING)::BIGINT AS sticky FROM lineitem")
def sticky_channels(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    got = fanin.sticky_channels(rows, "l_orderkey", ["l_shipdate", "l_partkey", "l_suppkey", "l_linenumber"], "l_linenumber")
    return got.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("sticky").cast("long").alias("sticky"))


@C.add(f"""WITH e AS (SELECT label, x, row_number() OVER (PARTITION BY label ORDER BY vec_id, pos) - 1 AS i FROM ({EACH}))
SELECT label, i // 1920 AS chunk, count(*) AS size, round(first(x ORDER BY i), 6) AS first_value, round(last(x ORDER BY i), 6) AS last_value FROM e GROUP BY label, i // 1920""")
def rechunk_1920(spark, sf_dir):
    got = ordering.rechunk(embeddings(spark, sf_dir), "label", "vec_id", "samples", 1920)
    return got.select("label", "chunk", F.size("samples").cast("long").alias("size"), r6(F.element_at("samples", 1)).alias("first_value"), r6(F.element_at("samples", -1)).alias("last_value"))


@C.add(f"""WITH e AS (SELECT label, x, row_number() OVER (PARTITION BY label ORDER BY vec_id, pos) - 1 AS i FROM ({EACH})),
l AS (SELECT label, i, x, coalesce(lead(x) OVER (PARTITION BY label ORDER BY i), x) AS y, max(i) OVER (PARTITION BY label) AS m FROM e),
k AS (SELECT label, unnest(range(ceil((m + 1) * 3 / 2.0)::BIGINT)) AS k FROM (SELECT DISTINCT label, m FROM l))
SELECT k.label, k.k, round(l.x + (l.y - l.x) * (k.k * 2 / 3.0 - l.i), 6) AS value FROM k JOIN l ON l.label = k.label AND l.i = (k.k * 2) // 3""")
def resample_linear(spark, sf_dir):
    """From 32 to 48 kHz."""
    got = clocks.resample(embeddings(spark, sf_dir), "label", "vec_id", "samples", 32_000, 48_000)
    return got.select("label", "k", r6(F.col("value")).alias("value"))


@C.add("""WITH d AS (SELECT label, vec_id, len(embedding) * 1000000 // 44100 AS duration_us FROM embeddings)
SELECT label, vec_id, duration_us, coalesce(sum(duration_us) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS timestamp_us,
       row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS sequence FROM d""")
def frame_timing(spark, sf_dir):
    got = clocks.frame_timing(embeddings(spark, sf_dir), "label", "vec_id", F.size("samples"), 44_100)
    return got.select("label", "vec_id", "duration_us", "timestamp_us", "sequence")


@C.add("""SELECT vec_id, 96::BIGINT AS size, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total, 0.0::DOUBLE AS last_value FROM embeddings""")
def opus_pad(spark, sf_dir):
    e = embeddings(spark, sf_dir).withColumn("samples", fr.pad(F.col("samples"), 96))
    return e.select("vec_id", F.size("samples").cast("long").alias("size"), F.round(fr.sum_of(F.col("samples")), 4).alias("total"), F.element_at("samples", -1).cast("double").alias("last_value"))


@C.add("SELECT vec_id, 32::BIGINT AS num_frames, (32 * 1000000 // 44100)::BIGINT AS duration_us FROM embeddings")
def frame_metrics(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return e.select("vec_id", fr.num_frames(F.col("samples"), F.lit(2)).alias("num_frames"), fr.duration_us(F.col("samples"), F.lit(2), F.lit(44_100)).alias("duration_us"))
