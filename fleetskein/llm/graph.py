"""Connected components over edge tables by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetskein.session import discard, passing, written


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node gets an edge to the node's smallest neighbour, itself included."""
    near = _both(edges)
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours get an edge to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node with an edge to another; component is the smallest node reachable.

    ``edges`` has long columns a, b; self loops and repeated edges do no harm. Each round is
    written to the shared folder; rounds end when the edge set stays as it is.
    """
    with passing():
        now = written(edges.where("a <> b").select("a", "b").distinct(), "edges")
        before = None
        while True:
            mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if mark == before or not mark[0]:
                break
            before, last = mark, now
            now = written(_small_star(_large_star(now)), "edges")
            discard(last)
        stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        return written(stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()), "linked", keep=True)
