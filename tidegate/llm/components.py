"""Connected components by alternating large and small stars, on edges that stay distributed. Nodes are longs or binary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import cut


def _stars(edges: DataFrame) -> DataFrame:
    """One large star and one small star. edges: a > b. Both keep the components."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b. Returns node, label: the least node that it is linked with, for every node of an edge."""
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            break
        mark = now
        e = cut(_stars(e))
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def forest(n: int, left: "list[int]", right: "list[int]") -> tuple[list[int], list[tuple[int, int]]]:
    """Roots (the least member) of n members under links, and the links that a spanning forest needs."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    used = []
    for i, j in zip(left, right):
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            used.append((i, j))
    return [find(i) for i in range(n)], used
