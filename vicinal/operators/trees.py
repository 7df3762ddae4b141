"""Ancestors and descendants over a table of edges, by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..staging import staged


def closure(edges: DataFrame) -> DataFrame:
    """node, up, steps: every ancestor of every node of the edges (parent, child); children have one parent.

    Round k joins pairs of up to 2 ** k steps with those of exactly so many, so a tree takes rounds by the logarithm of its
    height. Edges that go round are an error.
    """
    rounds = [staged(edges.select(F.col("child").alias("node"), F.col("parent").alias("up"), F.lit(1).cast("long").alias("steps")).distinct(), "closure")]
    while True:
        if not rounds[-1].filter("node = up").isEmpty():
            raise ValueError("the edges go round")
        every, steps = rounds[0], 1 << len(rounds) - 1
        for r in rounds[1:]:
            every = every.union(r)
        jump = every.filter(F.col("steps") == steps).select(F.col("node").alias("up"), F.col("up").alias("far"))
        new = staged(every.join(jump, "up").select("node", F.col("far").alias("up"), (F.col("steps") + steps).alias("steps")), "closure")
        if new.isEmpty():
            return every
        rounds.append(new)


def subtrees(edges: DataFrame) -> DataFrame:
    """node, depth, n_below, n_tips: of every node the steps from its root, its descendants, and the tips among them (a tip has one, itself)."""
    pairs = closure(edges)
    nodes = edges.select(F.col("child").alias("node")).union(edges.select("parent")).distinct()
    inner = edges.select(F.col("parent").alias("node")).distinct().withColumn("inner", F.lit(True))
    depth = pairs.groupBy("node").agg(F.max("steps").alias("depth"))
    below = pairs.join(inner, "node", "left").groupBy(F.col("up").alias("node")).agg(F.count("*").alias("n_below"), F.sum(F.when(F.col("inner"), 0).otherwise(1)).alias("n_tips"))
    d = nodes.join(depth, "node", "left").join(below, "node", "left")
    zero = F.lit(0).cast("long")
    return d.select("node", F.coalesce("depth", zero).alias("depth"), F.coalesce("n_below", zero).alias("n_below"), F.coalesce("n_tips", zero + 1).alias("n_tips"))
