"""Counters, states, load reports and eviction."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegate.catalogue.common import Catalogue, micros, r6, table
from tidegate.operators import stats

C = Catalogue()
QUERIES, ORACLE_SQL = C.queries, C.sql


@C.add("""SELECT event_type, count(*) AS received, count(*) FILTER (WHERE value < 100) AS sent, count(*) FILTER (WHERE value >= 100 AND value < 200) AS discarded, count(*) FILTER (WHERE value >= 200) AS errored FROM events GROUP BY event_type""")
def node_stats(spark, sf_dir):
    v = F.col("value")
    return stats.node_stats(table(spark, sf_dir, "events"), "event_type", v < 100, (v >= 100) & (v < 200), v >= 200)


@C.add("""WITH r AS (SELECT event_type, event_id, count(*) OVER w AS received, count(*) FILTER (WHERE value < 100) OVER w AS sent, count(*) FILTER (WHERE value >= 200) OVER w AS errored
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_type, event_id, received, sent, errored FROM r WHERE received = 1 OR greatest(received, sent, errored) % 100 = 0""")
def stats_snapshots(spark, sf_dir):
    v = F.col("value")
    got = stats.snapshots(table(spark, sf_dir, "events").withColumn("at", micros("ts")), "event_type", "at", "event_id", v < 100, v >= 200, 100)
    return got.select("event_type", "event_id", "received", "sent", "errored")


@C.add("SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS state FROM orders GROUP BY o_custkey")
def latest_state(spark, sf_dir):
    return stats.latest(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderstatus").withColumnRenamed("o_orderstatus", "state")


@C.add("""WITH l AS (SELECT o_orderstatus AS state, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous FROM orders)
SELECT previous, state, count(*) AS n FROM l WHERE previous IS NOT NULL AND previous <> state GROUP BY previous, state""")
def state_transitions(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "state")
    return stats.transitions(rows, "o_custkey", ["o_orderdate", "o_orderkey"], "state")


@C.add("""WITH l AS (SELECT o_custkey, o_orderkey, o_orderstatus AS s, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders),
c AS (SELECT * FROM l WHERE p IS NULL OR p <> s)
SELECT o_custkey, o_orderkey, p AS state, 0 AS gauge FROM c WHERE p IS NOT NULL UNION ALL SELECT o_custkey, o_orderkey, s, 1 FROM c""")
def state_gauges(spark, sf_dir):
    got = stats.one_hot(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderstatus")
    return got.select("o_custkey", "o_orderkey", "state", "gauge")


_FIGURES = """count(*) AS total, count(ok) AS succeeded, round(count(ok) * 100.0 / count(*), 6) AS success_rate, min(ok) AS least, max(ok) AS most, round(avg(ok), 6) AS mean,
quantile_disc(ok, 0.5) AS p50, quantile_disc(ok, 0.95) AS p95, quantile_disc(ok, 0.99) AS p99"""


def _rounded(df, *by):
    return df.select(*by, "total", "succeeded", r6(F.col("success_rate")).alias("success_rate"), "least", "most", r6(F.col("mean")).alias("mean"), "p50", "p95", "p99")


@C.add(f"WITH l AS (SELECT l_returnflag, l_linestatus, CASE WHEN l_discount < 0.08 THEN l_quantity END AS ok FROM lineitem) SELECT l_returnflag, l_linestatus, {_FIGURES} FROM l GROUP BY l_returnflag, l_linestatus")
def op_report(spark, sf_dir):
    """Load report of each operation: line items are requests, their quantity the latency."""
    got = stats.report(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", F.col("l_discount") < 0.08)
    return _rounded(got, "l_returnflag", "l_linestatus")


@C.add(f"WITH l AS (SELECT CASE WHEN event_type <> 'error' THEN value END AS ok FROM events) SELECT {_FIGURES} FROM l")
def overall_report(spark, sf_dir):
    return _rounded(stats.report(table(spark, sf_dir, "events"), [], "value", F.col("event_type") != "error", spread=True))


@C.add("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type")
def reservoir_exact(spark, sf_dir):
    """Exact nearest-rank percentiles in place of a reservoir."""
    return stats.ranks(table(spark, sf_dir, "events"), ["event_type"], "value", [50, 95, 99])


@C.add("""WITH b AS (SELECT l_returnflag, count(*) AS total, count(*) FILTER (WHERE l_discount < 0.08) AS succeeded, max(l_shipdate) AS b, min(l_shipdate) AS a FROM lineitem GROUP BY l_returnflag)
SELECT l_returnflag, round(total / ((epoch_us(b) - epoch_us(a)) / 86400000000.0), 6) AS per_day, round(succeeded / ((epoch_us(b) - epoch_us(a)) / 86400000000.0), 6) AS succeeded_per_day FROM b""")
def throughput(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("at", micros("l_shipdate"))
    days = (F.max("at") - F.min("at")) / F.lit(86_400_000_000.0)
    return rows.groupBy("l_returnflag").agg(r6(F.count("*") / days).alias("per_day"), r6(F.count_if(F.col("l_discount") < 0.08) / days).alias("succeeded_per_day"))


@C.add("SELECT event_type, count(*) AS n FROM events WHERE value > 100 GROUP BY event_type ORDER BY n DESC, event_type LIMIT 1")
def top_error(spark, sf_dir):
    return stats.top_error(table(spark, sf_dir, "events").where("value > 100"), "event_type")


@C.add("SELECT p_type, count(*) AS n, sum(p_size)::BIGINT AS total_size FROM part GROUP BY p_type")
def resource_stats(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_type").agg(F.count("*").alias("n"), F.sum("p_size").cast("long").alias("total_size"))


@C.add("""WITH r AS (SELECT p_partkey, p_size, sum(p_size) OVER (ORDER BY p_retailprice, p_partkey ROWS UNBOUNDED PRECEDING)::BIGINT AS freed FROM part)
SELECT p_partkey, freed FROM r WHERE freed - p_size < 5000""")
def lru_evict(spark, sf_dir):
    """Parts are resources, last used in the order of their price."""
    got = stats.evict(table(spark, sf_dir, "part"), "p_retailprice", "p_partkey", "p_size", 5000)
    return got.select("p_partkey", F.col("freed").cast("long").alias("freed"))


@C.add("""SELECT o_orderpriority, count(*) AS distributed, count(*) FILTER (WHERE o_totalprice > 300000) AS best_effort_drops, count(DISTINCT o_custkey) AS outputs_active, round(sum(o_totalprice), 2) AS send_wait FROM orders GROUP BY o_orderpriority""")
def distributor_metrics(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    got = o.groupBy("o_orderpriority").agg(F.count("*").alias("distributed"), F.count_if(F.col("o_totalprice") > 300000).alias("best_effort_drops"), F.count_distinct("o_custkey").alias("outputs_active"), F.sum("o_totalprice").alias("send_wait"))
    return got.withColumn("send_wait", F.round("send_wait", 2))


@C.add("SELECT event_type, floor(value / 50)::BIGINT AS bucket, count(*) AS n FROM events GROUP BY 1, 2")
def duration_histogram(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", F.floor(F.col("value") / 50).alias("bucket")).agg(F.count("*").alias("n"))
