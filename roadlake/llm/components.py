"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlake.llm.base import materialize


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long); component is its smallest node.

    Alternates large-star and small-star steps: each node hooks its larger, then its smaller
    neighbours to the least of its neighbourhood, until nothing changes. The number of edges never
    grows, stars of any size are aggregated with map-side combining, and every round is written, so
    that a lost executor repeats one round at most. ``rounds`` only guards against a loop that does
    not end (log2 of the longest path, squared, bounds them); passing it raises.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialize(e, "cc-edges")
    before = None
    for _ in range(rounds):
        large = _star(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))), larger=True)
        e = materialize(_star(large, larger=False), "cc-round")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """Large star: every node's larger neighbours hook to the least of it and its neighbours.
    Small star (links point from the larger end): the same for its smaller neighbours and itself."""
    least = links.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = links.join(least, "a")
    if larger:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
