"""Connected components of a graph that is only ever held in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitgate.llm.common import Stages


def connected(edges: DataFrame, stages: Stages, name: str) -> DataFrame:
    """(node, component) for all nodes of the undirected ``edges`` (a, b); the component is its smallest node.

    Large-star and small-star steps in turn: neighbours of a node are linked to the smallest of
    them, until nothing changes; the number of rounds grows with the logarithm of the size.
    Every round is written, so lineage stays short. A node of high degree is a group that is
    aggregated (a minimum) and joined back, never collected.
    """
    flat = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now = stages.write(flat, f"{name}-0")
    step = 0
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stages.write(large.distinct(), f"{name}-{step}-large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        small = small.select("e.a", "e.b").where("a <> b").distinct()
        step += 1
        new = stages.write(small, f"{name}-{step}")
        stages.drop(f"{name}-{step - 1}-large")
        # converged when every node has one neighbour and that neighbour is smaller than all: stars only
        bad = new.join(new.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()
        several = new.groupBy("a").count().where("count > 1").limit(1).count()
        now = new
        if not bad and not several:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
