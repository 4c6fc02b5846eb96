"""Connected components of a graph given as edges, by contraction.

Each round every node takes, of itself and its neighbours, the one that comes
first in the round's hash order; edges are then drawn between the chosen nodes,
without loops and repetitions, until none is left. A round removes a constant
part of the nodes of a connected graph, stars fall together at once, and only
minima by node are shuffled, so a node with very many edges is no hot group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """``edges``: a, b (long). Returns id and component, the least id that it
    is connected with, for every node that has an edge to another."""
    edges = stored(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    first, steps, turn = edges, [], 0
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("id"))  # noqa: B023, E731
        step = both.groupBy("a").agg(F.least(F.min(order("b")), F.first(order("a")))["id"].alias("to")).select(F.col("a").alias("id"), "to")
        step = stored(step, "component-step")
        steps.append(step)
        to = edges.join(step.select(F.col("id").alias("a"), F.col("to").alias("x")), "a").join(step.select(F.col("id").alias("b"), F.col("to").alias("y")), "b")
        edges = stored(to.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        turn += 1
    if not steps:
        return first.select(F.col("a").alias("id"), F.col("b").alias("component"))
    found = steps[0].select("id", F.col("to").alias("at"))
    for step in steps[1:]:
        nxt = step.select(F.col("id").alias("at"), "to")
        found = found.join(nxt, "at", "left").select("id", F.coalesce("to", "at").alias("at"))
    least = found.groupBy("at").agg(F.min("id").alias("component"))
    return stored(found.join(least, "at").select("id", "component"), "components")
