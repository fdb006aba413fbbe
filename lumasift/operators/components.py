"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumasift.scratch import saved

#: Edges that one task takes on: a small graph is a few tasks, however many partitions shuffles have.
EDGES_PER_TASK = 200_000


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Each node's larger neighbours move to the smallest of its neighbourhood."""
    both = _both(edges)
    low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")).coalesce(tasks)
    moved = both.filter(F.col("b") > F.col("a")).join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.coalesce(tasks).distinct().coalesce(tasks)


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Each node's smaller neighbours, and the node, move to the smallest of them; ``edges`` have a > b."""
    low = edges.groupBy("a").agg(F.min("b").alias("low")).coalesce(tasks)
    moved = edges.join(low, "a").filter(F.col("b") != F.col("low")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(low.select("a", F.col("low").alias("b"))).coalesce(tasks).distinct().coalesce(tasks)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node of each node's component.

    Nodes without an edge, and null ends, are absent; self-loops count as a
    node of its own.  Every step is a partial aggregation and a join of edges;
    each round is a table in the shared folder.  The graph stays distributed,
    only a count and a checksum reach the driver.
    """
    given = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    given = saved(given, "cc-given")
    tasks = max(1, -(-given.count() // EDGES_PER_TASK))
    stars = given.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    stars = saved(stars.coalesce(tasks).distinct().coalesce(tasks), "cc-edges")
    mark = _mark(stars)
    for k in range(max_rounds):
        large = saved(_large_star(stars, tasks), f"cc-large-{k}")
        stars = saved(_small_star(large, tasks), f"cc-small-{k}")
        last, mark = mark, _mark(stars)
        if mark == last:
            break
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    own = given.select(F.col("a").alias("node")).filter(F.lit(False)).withColumn("component", F.col("node"))
    if given.filter(F.col("a") == F.col("b")).take(1):
        own = given.filter(F.col("a") == F.col("b")).select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("component"))
    found = stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots).unionByName(own)
    return found.coalesce(tasks).groupBy("node").agg(F.min("component").alias("component")).coalesce(tasks)
