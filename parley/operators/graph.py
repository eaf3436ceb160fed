"""Connected components on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialize


def least_of_neighbours(pairs: DataFrame) -> DataFrame:
    """Links (u, v) from each greater neighbour to the least one, and repeats, before they are
    made distinct: the join of a round, whose sides AQE may split."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).hint("rebalance")
    return both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star steps.

    edges: a long, b long (no nulls; self loops and repeats are ignored). Returns node, root
    for every node that has a link to another node; root is the smallest node of the
    component. Least neighbours are aggregated map-side and dealt anew before they are joined,
    so neither side of a join rests on the aggregate's partitioning and AQE can split a hub with
    a third of all links; nothing is gathered per node.
    """
    pairs = materialize(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "links",
    )
    state = None
    for _ in range(max_rounds):
        now = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == now or not now["n"]:
            break
        state = now
        large = materialize(least_of_neighbours(pairs).distinct(), "large")
        star = large.groupBy("u").agg(F.min("v").alias("m")).hint("rebalance")
        moved = large.join(star, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        step = materialize(
            moved.unionByName(star.select("u", F.col("m").alias("v")))
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            .where("u <> v")
            .distinct(),
            "links",
        )
        discard(pairs)
        discard(large)
        pairs = step
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
