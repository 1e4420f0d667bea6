"""Connected components of a graph given as edges, by alternating large and small stars.

Every round is two aggregates and two joins over the edges; nothing but a number
that tells whether all components are stars comes to the driver. Each round's
edges are written to the shared folder, which ends the lineage, and the round
before is deleted. A node that a large part of the edges meet in is looked up in
as many tasks as it needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.shared import Steps, look_up


HUB = 10_000  # with a node of more edges than this, rounds look nodes up in as many tasks as they need


def _towards_min(edges: DataFrame, both_ways: bool, hub: Steps | None) -> DataFrame:
    """Large star (both_ways): hang a node's larger neighbours on its least one. Small star: the smaller ones."""
    if both_ways:
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = edges.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"), F.count("*").alias("n"))
    if hub:
        least = hub.settle(least)
        linked = look_up(edges, least, ["u"], "n", ["v"])
    else:
        linked = edges.join(least.drop("n"), "u")
    if both_ways:
        return linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return linked.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)


def _shape(edges: DataFrame) -> tuple[bool, int]:
    """Whether every node hangs on one other at most and none that hangs on another holds any; the most edges of a node."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))))
    nodes = edges.select(ends.alias("e")).groupBy("e.node").agg(F.sum("e.up").alias("up"), F.sum("e.down").alias("down"))
    worst, most = nodes.agg(F.max(F.greatest(F.col("up") - 1, F.least("up", "down"))), F.max(F.col("up") + F.col("down"))).first()
    return not worst, most or 0


def connected_components(edges: DataFrame, u: str, v: str, most_rounds: int = 60) -> DataFrame:
    """`node` and `root` for every node that has an edge; the root is the component's least node."""
    a, b = F.col(u), F.col(v)
    steps = Steps(edges.sparkSession)
    edges = steps.settle(edges.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    for _ in range(most_rounds):
        stars, most = _shape(edges)
        if stars:
            break
        hub = steps if most > HUB else None
        large = _towards_min(edges, True, hub).filter("u <> v").distinct()
        edges = steps.settle(_towards_min(steps.settle(large) if hub else large, False, hub).filter("u <> v").distinct())
        steps.done(edges)
    else:
        raise RuntimeError(f"components have not settled in {most_rounds} rounds")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
