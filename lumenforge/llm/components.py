"""Connected components by alternating large and small stars, every step of it DataFrame joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _least(pairs: DataFrame) -> DataFrame:
    """For each u the least of itself and its v, written: a join with it has plain exchanges on both sides, so AQE splits hot nodes."""
    return saved(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has an edge; the root is the least node of its component.

    In a round, each node first hands its larger neighbours to the least it knows, then its smaller ones: paths shrink by
    half, and the edges end as stars around the roots. Rounds end when nothing changes. Null ends and loops are ignored."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    stars = saved(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(hi.alias("u"), lo.alias("v")).where("u <> v").distinct())
    for _ in range(most_rounds):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = saved(both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = _least(large)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = saved(small.where("u <> v").distinct())
        # Done when the edges are what they were: every node then hangs on its root alone.
        sign = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        done = sign(after) == sign(stars)
        stars = after
        if done:
            break
    else:
        raise RuntimeError("components have not settled")
    roots = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
