"""Connected components of an edge list, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.functions.durable import cut


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of the undirected edges ``(u, v)``; a component is named by its smallest node.

    Runs jobs: each round is checkpointed.  Nodes without an edge do not appear; self loops and repeated edges are
    harmless; edges with a null end are ignored; an empty edge list gives an empty result.  A hub of any degree costs one
    partial minimum and one join, never a list of its neighbours.  Joins stay merges of what is shuffled anyway: turned into
    broadcasts round after round, small tables would pile up in the driver.
    """
    edges = cut(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), F.col("u").isNotNull().alias("a"), F.col("v").isNotNull().alias("b"))
        .where("a and b and u <> v").select("u", "v").distinct()
    )
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.union(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        after = _state(edges)
        if after == state:
            break
        state = after
    # Every node now points at its root; roots point at nothing and are added.
    return (
        edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        .union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")))
        .distinct()
    )
