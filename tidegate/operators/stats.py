"""Counters of nodes, states over time, load reports and eviction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.operators.ordering import before, ordered, range_totals, running_total, upto


def node_stats(df: DataFrame, node: str, sent: Column, discarded: Column, errored: Column) -> DataFrame:
    return df.groupBy(node).agg(F.count("*").alias("received"), F.count_if(sent).alias("sent"), F.count_if(discarded).alias("discarded"), F.count_if(errored).alias("errored"))


def snapshots(df: DataFrame, node: str, key: str, tie: str, sent: Column, errored: Column, every: int = 1000) -> DataFrame:
    """A node's counters at its first packet and whenever the largest is a multiple of `every`; packets are in the order of a
    numeric key and a tie."""
    rows = range_totals(df, [node], key, tie, {"received": F.lit(1), "sent": F.coalesce(sent, F.lit(False)).cast("int"), "errored": F.coalesce(errored, F.lit(False)).cast("int")})
    return rows.where((F.col("received") == 1) | (F.greatest("received", "sent", "errored") % every == 0))


def latest(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Last write wins."""
    return df.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def transitions(df: DataFrame, stream: str, order: list[str], state: str) -> DataFrame:
    """How often each state follows each other one."""
    rows = df.withColumn("previous", F.lag(state).over(ordered([stream], order)))
    return rows.where(F.col("previous").isNotNull() & (F.col("previous") != F.col(state))).groupBy("previous", state).agg(F.count("*").alias("n"))


def nearest_rank(value: str, percent: int) -> Column:
    """sorted[ceil(p / 100 * n) - 1]: an element of the input, never between two."""
    return F.expr(f"percentile_disc({percent / 100}) WITHIN GROUP (ORDER BY {value})")


def ranks(df: DataFrame, by: list[str], value: str, percents: list[int], ranges: int = 128) -> DataFrame:
    """Exact nearest-rank percentiles of a few groups with very many different values: by, p{percent}.

    Values are counted, their counts summed by ranges, and only the ranges that hold a wanted rank are sorted, so no task
    holds a group. Nulls don't count; a group of nulls has null percentiles."""
    one = df.select(*by, F.col(value).alias("__v"), F.lit(1).alias("__all"))
    own = ["__all", *by]
    counts = one.where("__v is not null").groupBy(*own, "__v").agg(F.count("*").alias("__n"))
    cuts = counts.groupBy(*own).agg(F.percentile_approx("__v", [k / ranges for k in range(1, ranges)], 1000).alias("__cuts"))
    placed = counts.join(cuts, own).withColumn("__range", F.size(F.filter("__cuts", lambda c: c < F.col("__v")))).drop("__cuts")
    sums = placed.groupBy(*own, "__range").agg(F.sum("__n").alias("__s"))
    whole = Window.partitionBy(*own)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__s").over(before(own, ["__range"])), F.lit(0))).withColumn("__total", F.sum("__s").over(whole))
    wanted = sums.withColumn("__p", F.explode(F.array(*map(F.lit, percents)))).withColumn("__k", F.greatest(F.ceil(F.col("__p") * F.col("__total") / 100), F.lit(1)) - F.col("__before"))
    wanted = wanted.where("__k > 0 and __k <= __s").select(*own, "__range", "__p", "__k")
    near = placed.join(wanted, [*own, "__range"])
    near = near.withColumn("__c", F.sum("__n").over(upto([*own, "__p"], ["__v"]))).where("__c >= __k")
    found = near.groupBy(*own).agg(*(F.min(F.when(F.col("__p") == p, F.col("__v"))).alias(f"p{p}") for p in percents))
    groups = one.groupBy(*own).agg(F.count("*").alias("__n"))
    same = [groups[c].eqNullSafe(found[c]) for c in own]
    return groups.join(found, reduce(lambda a, b: a & b, same), "left").select(*(groups[c] for c in by), *(f"p{p}" for p in percents))


def report(df: DataFrame, by: list[str], value: str, success: Column, exact: bool = True, spread: bool = False) -> DataFrame:
    """Counts, success rate, and latency figures of the successes. exact=False takes bounded sketches instead of exact
    percentiles; spread=True works out exact ones by `ranks`, for columns with very many different values (by: no nulls)."""
    rows = df.withColumn("__ok", F.when(success, F.col(value)))
    rank = (lambda p: nearest_rank("__ok", p)) if exact else (lambda p: F.percentile_approx("__ok", p / 100, 10_000))
    figures = [F.count("*").alias("total"), F.count("__ok").alias("succeeded"), (F.count("__ok") / F.count("*") * 100).alias("success_rate"), F.min("__ok").alias("least"), F.max("__ok").alias("most"), F.avg("__ok").alias("mean")]
    if not spread:
        return rows.groupBy(*by).agg(*figures, *(rank(p).alias(f"p{p}") for p in (50, 95, 99)))
    told, found = rows.groupBy(*by).agg(*figures), ranks(rows, by, "__ok", [50, 95, 99])
    return told.join(found, by, "left") if by else told.withColumn("__one", F.lit(1)).join(found.withColumn("__one", F.lit(1)), "__one", "left").drop("__one")


def write_report(figures: DataFrame, path: str, form: str = "json") -> None:
    """A report, which has a row for each operation, as JSON lines or as CSV with a head."""
    if form not in ("json", "csv"):
        raise ValueError(f"unknown form '{form}'")
    figures.coalesce(1).write.mode("overwrite").format(form).option("header", True).save(path)


def top_error(df: DataFrame, message: str) -> DataFrame:
    """The most frequent message; the first by name among equals."""
    counts = df.groupBy(message).agg(F.count("*").alias("n"))
    return counts.orderBy(F.col("n").desc(), message).limit(1)


def evict(df: DataFrame, used: str, tie: str, size: str, target: int) -> DataFrame:
    """Least recently used first, until `target` is freed: rows whose predecessors free less than that."""
    rows = running_total(df, used, F.col(size), "freed", tie)
    return rows.where(F.col("freed") - F.col(size) < target)


def one_hot(df: DataFrame, stream: str, order: list[str], state: str) -> DataFrame:
    """Gauge writes of a state change: the state that ends goes to 0, the one that begins to 1."""
    rows = df.withColumn("__was", F.lag(state).over(Window.partitionBy(stream).orderBy(*order)))
    rows = rows.where(F.col("__was").isNull() | (F.col("__was") != F.col(state)))
    pairs = F.array(F.struct(F.col("__was").alias("state"), F.lit(0).alias("gauge")), F.struct(F.col(state).alias("state"), F.lit(1).alias("gauge")))
    return rows.select(stream, *order, F.explode(pairs).alias("g")).select(stream, *order, "g.state", "g.gauge").where("state is not null")
