"""Connected components of a distributed link table by alternating small-star and large-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import discard, materialize


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``links`` (a, b: long) -> (node, root): root is the smallest node reachable, for each node that has a smaller one.

    Every link is turned to point from its larger end u to its smaller end v.
    A small-star step hangs all smaller neighbours of u below the smallest; a large-star step replaces v
    by v's own smallest neighbour. Both keep components and end in one star for each. A node's smallest neighbour is
    an aggregate with partial results before the shuffle, and is joined back to plain tables, so AQE may broadcast it or split a
    popular node. Each round is written to the shared folder: no lineage grows, nothing is collected.
    Nulls and self-links are ignored; an empty table gives an empty table.
    """
    edges = materialize(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    for _ in range(max_rounds):
        low = edges.join(edges.groupBy("u").agg(F.min("v").alias("p")), "u")
        hung = F.when(F.col("v") == F.col("p"), F.col("u")).otherwise(F.col("v"))
        small = materialize(
            low.select(hung.alias("u"), F.col("p").alias("v"), (F.col("v") != F.col("p")).alias("moved"))
            .union(low.select("u", F.col("p").alias("v"), F.lit(False).alias("moved")))
            .groupBy("u", "v").agg(F.max("moved").alias("moved")),
            "small-star",
        )
        parent = materialize(small.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("up")), "parents")
        large = materialize(
            small.join(parent, "v", "left")
            .select("u", F.coalesce("up", "v").alias("v"), (F.col("moved") | F.col("up").isNotNull()).alias("moved"))
            .groupBy("u", "v").agg(F.max("moved").alias("moved")),
            "large-star",
        )
        for old in (edges, small, parent):
            discard(old)
        edges = large.select("u", "v")
        if large.where("moved").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
