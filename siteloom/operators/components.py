"""Disjoint sets as connected components: alternating large-star and small-star steps, all in DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """df from a checkpoint in the folder of spark.checkpoint.dir; where that is unset, one of our own in local mode, else an error."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not path and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(path or f"file:///tmp/siteloom-checkpoints/{sc.applicationId}")
    return df.checkpoint()


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked with the node's least neighbour (or itself)."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return _distinct(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked with the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return _distinct(down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))))


def connected(edges: DataFrame, keep: Callable[[DataFrame], DataFrame] = checkpointed) -> DataFrame:
    """edges (a, b), in either direction -> (node, label): for each node of an edge but the least ones of their components,

    the least node that it is linked with. Self-links are dropped. keep cuts the lineage of each round's edges; the number
    of rounds grows with the logarithm of the longest path.
    """
    now, before = keep(_distinct(edges.select("a", "b"))), None
    while True:
        now = keep(_small_star(_large_star(now)))
        said = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if said == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label"))
        before = said
