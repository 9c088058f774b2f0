"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm._work import discard, materialise


def _stars(edges: DataFrame, name: str) -> DataFrame:
    """(u, v) with v's neighbours moved to the least of u's neighbourhood; the minima are a table of their own, so that
    the join deals both sides anew and a hub with most of the edges can be split over tasks."""
    least = materialise(edges.groupBy("u").agg(F.min("v").alias("m")), f"{name}-min")
    return edges.join(least, "u"), least


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the undirected edges; component is the least node of the component.

    Nodes are longs. Self-loops, repeated edges and edges with a null end are allowed and add nothing (a node with
    self-loops only is absent). No edges give an empty table. Every round is a table in the shared folder.
    """
    spark = edges.sparkSession
    now = materialise(
        edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"), F.col(a).isNotNull().alias("x"), F.col(b).isNotNull().alias("y"))
        .where("x and y and u <> v").select("u", "v").distinct(), "edges",
    )
    state = _state(now)
    for _ in range(rounds):
        if not state[0]:
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        moved, least = _stars(both, "large")
        large = materialise(moved.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct(), "large")
        discard(spark, least)
        moved, least = _stars(large, "small")
        small = materialise(moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "small")
        after = _state(small)
        for old in (least, large, now):
            discard(spark, old)
        now = small
        if after == state:
            break
        state = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
