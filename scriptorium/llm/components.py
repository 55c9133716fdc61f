"""Connected components by alternating large and small stars, in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm._common import drop, stage


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and component (the smallest node that it reaches) for every node in edges (columns a and b, not null).

    Each round hangs all larger neighbours of a node, then all smaller ones, on its smallest neighbour. The neighbours of a node are
    never gathered: minima are combined before the shuffle and joined back, and AQE splits the partition of a node with many edges.
    """
    now = stage(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = held = None
    for _ in range(most_rounds):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(small_least, "a")
        small = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).union(hung.select("a", F.col("m").alias("b")))
        held, now = now, stage(small.where("a != b").distinct())
        drop(held)
        last, state = state, now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
