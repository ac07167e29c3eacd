"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from etlspec.llm.common import settled

ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; the component is its smallest node.

    Alternating large and small stars: every round joins each node's neighbours
    to the smallest one. The number of rounds grows with the logarithm of the
    longest path, each is two aggregations and two joins over the edges left,
    and each result is written to shared storage, so lost executors cost one
    round. Nothing but one checksum row a round reaches the driver. No edges
    give no rows.
    """
    now = settled(_distinct(edges.select("a", "b")))
    before = None
    for _ in range(ROUNDS):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        now = settled(_small_star(_large_star(now)))
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _distinct(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger node to the smaller one."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Join the neighbours above each node to the smallest of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    joined = edges.select(F.col("b").alias("a"), F.col("a").alias("far")).join(low, "a")
    return _distinct(joined.select(F.col("far").alias("a"), F.col("low").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Join each node and the neighbours below it to the smallest of them."""
    low = edges.groupBy("a").agg(F.min("b").alias("low"))
    joined = edges.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return _distinct(joined.unionByName(low.select("a", F.col("low").alias("b"))))
