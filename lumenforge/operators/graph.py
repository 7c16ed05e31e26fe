"""Connected components of a table of edges by joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import saved


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has an edge; the root is the least node it is connected with. Nodes are of any type with
    an order; null ends and loops are ignored.

    Each node points to a node of its component that is not greater. In a round, an edge between nodes that point to different
    ones offers the lesser to all that point to the greater, and every node goes on to where its goal pointed. Pointers only
    fall; when no edge has an offer, all nodes of a component point to the same one, its least."""
    plain = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    both = saved(plain.unionByName(plain.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    points = saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("root")))
    for _ in range(most_rounds):
        to = lambda end: points.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))  # noqa: B023, E731
        offers = saved(both.join(to("a"), "a").join(to("b"), "b").where("root_b < root_a").groupBy(F.col("root_a").alias("root")).agg(F.min("root_b").alias("offered")))
        if offers.isEmpty():
            return points
        onward = points.where("node <> root").select(F.col("node").alias("root"), F.col("root").alias("next"))
        moved = points.join(offers, "root", "left").select("node", F.coalesce("offered", "root").alias("root"))
        points = saved(moved.join(onward, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
    raise RuntimeError("components have not settled")
