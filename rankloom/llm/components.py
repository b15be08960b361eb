"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import skew_join, stored


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge, root the smallest node that it reaches.

    Each round is two aggregations to (node, smallest neighbour), joined back to the edges; a chain of n
    nodes ends after about log2(n) rounds. Every round is written to the shared folder, so that a lost
    executor costs one round at most. Nothing of the edges comes to the driver but their number and a
    checksum. A hub (a node of very many edges) only ever meets a pre-aggregated minimum, which is
    broadcast to its edges (skew_join).

    Self-edges and repeated edges are harmless; an empty table gives an empty one.
    """
    pairs = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = stored(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = None
    for _ in range(most_rounds):
        print_of = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if print_of == before:
            break
        before = print_of
        # Large star: every neighbour above a node goes to the smallest of its neighbourhood.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("m", "u"))
        large = stored(skew_join(both.where("v > u"), least, "u", "n", 2 * print_of[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        # Small star: a node and its smaller neighbours go to the smallest of these.
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        met = skew_join(large, least, "u", "n", 2 * print_of[0])
        small = met.select(F.col("u"), F.col("m").alias("v")).unionByName(met.select(F.col("v").alias("u"), F.col("m").alias("v")))
        now = stored(small.where("u <> v").distinct())
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
