"""Queries about graphs: fan-out and fan-in, levels, and which types may be connected."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegate.catalogue.common import Catalogue, table
from tidegate.plans.compiler import compile_pipeline, levels
from tidegate.plans.registry import allowed_column
from tidegate.plans.types import ANY, BINARY, OPUS, PASSTHROUGH, TEXT, TRANSCRIPTION, can_connect, custom, raw_audio

C = Catalogue()
QUERIES, ORACLE_SQL = C.queries, C.sql

#: A graph with a fan-out and two fan-ins.
GRAPH = {
    "nodes": {
        "upload": {"kind": "io::input"},
        "file": {"kind": "io::input"},
        "gain": {"kind": "audio::gain", "needs": "file"},
        "mixer": {"kind": "audio::mixer", "needs": ["upload", "gain"]},
        "tap": {"kind": "core::telemetry_tap", "needs": "mixer"},
        "side": {"kind": "core::sink", "needs": {"node": "mixer", "mode": "best_effort"}},
        "out": {"kind": "io::output", "needs": ["tap"]},
    }
}
_EDGES = "(VALUES ('file', 'gain'), ('upload', 'mixer'), ('gain', 'mixer'), ('mixer', 'tap'), ('mixer', 'side'), ('tap', 'out')) AS e(a, b)"
_NODES = "(VALUES ('upload'), ('file'), ('gain'), ('mixer'), ('tap'), ('side'), ('out')) AS n(node)"


@C.add("SELECT r_name, branch, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey, (VALUES ('in_0'), ('in_1')) AS t(branch) WHERE branch = 'in_0' OR n_nationkey % 2 = 0 GROUP BY r_name, branch")
def fanout_union(spark, sf_dir):
    """One output read twice and brought together again, each branch under the name of its pin."""
    n = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    both = n.withColumn("branch", F.lit("in_0")).unionByName(n.where("n_nationkey % 2 = 0").withColumn("branch", F.lit("in_1")))
    return both.groupBy("r_name", "branch").agg(F.count("*").alias("n"))


@C.add(f"""WITH RECURSIVE l(node, level) AS (SELECT node, 0 FROM {_NODES} UNION ALL SELECT e.b, l.level + 1 FROM l JOIN {_EDGES} ON e.a = l.node)
SELECT node, max(level) AS level FROM l GROUP BY node""")
def topo_levels(spark, sf_dir):
    return spark.createDataFrame(list(levels(compile_pipeline(GRAPH)).items()), "node string, level int")


_TYPES = {
    "any": ANY,
    "passthrough": PASSTHROUGH,
    "text": TEXT,
    "transcription": TRANSCRIPTION,
    "binary": BINARY,
    "opus": OPUS,
    "audio_48k_2": raw_audio(48_000, 2),
    "audio_48k_1": raw_audio(48_000, 1),
    "audio_48k_any": raw_audio(48_000, 0),
    "audio_any": raw_audio(),
    "audio_any_s16": raw_audio(0, 0, "S16"),
    "custom_a": custom("a@1"),
    "custom_b": custom("b@1"),
}
_ROWS = ", ".join(f"('{n}', '{t.kind}', {t.get('sample_rate') or 0}, {t.get('channels') or 0}, '{t.get('sample_format') or t.get('type_id') or ''}')" for n, t in _TYPES.items())


@C.add(f"""WITH t(name, kind, rate, channels, form) AS (VALUES {_ROWS})
SELECT a.name AS output, b.name AS input, CASE WHEN a.kind = 'Any' OR b.kind = 'Any' THEN TRUE WHEN a.kind <> b.kind OR a.kind = 'Passthrough' THEN FALSE
ELSE (a.rate = b.rate OR a.rate = 0 OR b.rate = 0) AND (a.channels = b.channels OR a.channels = 0 OR b.channels = 0) AND a.form = b.form END AS fits FROM t a, t b""")
def type_compat_matrix(spark, sf_dir):
    return spark.createDataFrame([(a, b, can_connect(x, y)) for a, x in _TYPES.items() for b, y in _TYPES.items()], "output string, input string, fits boolean")


@C.add("SELECT event_type, event_type LIKE 'c%' OR event_type = 'view' AS permitted FROM (SELECT DISTINCT event_type FROM events)")
def allow_list(spark, sf_dir):
    """Kinds against an allow-list of shell patterns."""
    rows = table(spark, sf_dir, "events").select("event_type").distinct()
    return rows.select("event_type", allowed_column(F.col("event_type"), ["c*", "view"]).alias("permitted"))
