"""Connected components of an edge table, by contraction.

Every node points at the neighbour (or itself) that comes first in a random order,
pointers are followed once more, and the edges are rewritten between the nodes pointed
at, until none is left. The number of nodes falls by a constant factor a round whatever
the graph looks like; a group is only ever reduced by min(), never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.llm.common import staged


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of ``edges`` (a, b); component is the least node
    reachable. Loops and repeated edges do no harm; no edges give no rows."""
    left = staged(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
                  "edges")
    names = None
    while not left.isEmpty():
        both = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
        first = staged(both.groupBy("a").agg(F.min(order("b")).alias("m"))
                       .select(F.col("a").alias("node"), F.least("m", order("a"))["id"].alias("to")), "pointers")
        jump = staged(first.join(first.select(F.col("node").alias("to"), F.col("to").alias("far")), "to")
                      .select("node", F.col("far").alias("to")), "pointers")
        names = jump if names is None else staged(
            names.join(jump.select(F.col("node").alias("to"), F.col("to").alias("far")), "to", "left")
            .select("node", F.coalesce("far", "to").alias("to")), "names")
        left = staged(left.join(jump.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
                      .join(jump.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
                      .where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
                      "edges")
    if names is None:
        return left.select(F.col("a").alias("node"), F.col("a").alias("component"))
    least = names.groupBy("to").agg(F.min("node").alias("component"))
    return names.join(least, "to").select("node", "component")
