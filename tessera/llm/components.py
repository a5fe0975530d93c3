"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One round over edges (a > b): each node's larger (or smaller) neighbours, and with the latter it, are hung on its smallest neighbour, or on it if it has no smaller one.

    The larger neighbours of a node may be very many. Its smallest is written before they are joined, so that Spark can
    split them.
    """
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
    if large:
        return edges.join(cut(least), F.col("b") == F.col("u"), "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
    hung = edges.join(least, F.col("a") == F.col("u")).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Columns node and component (its smallest node) for every node on an edge (a, b); edges that join a node to itself count for nothing.

    Each round is written to the shared checkpoint folder, so the plan stays short and lost executors lose nothing.
    """
    now = cut(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen, now = mark, cut(star(star(now, True), False))
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
