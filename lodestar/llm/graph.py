"""Connected components as repeated contraction of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, materialize, table_mark


def connected_components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` edges to ``(node, root)`` rows, where root is the least node of the component.

    Each round points every node to its least neighbour, follows one pointer more, and contracts
    the edges to what is left between groups, so the edge table shrinks geometrically. ``min`` is
    combined before the shuffle, so a hub that holds a third of all edges sends one row per task;
    the joins on a hub's key are left to adaptive skew splitting. Only nodes with an edge are
    returned. Null ends and self loops are ignored; repeated edges do not matter. Tables of the rounds
    are removed; the result is one table.
    """
    spark, mark = edges.sparkSession, table_mark()
    edges = materialize(edges.select("a", "b").where("a <> b").distinct(), "edges")
    levels = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to"))
        step = materialize(step, "step")
        hop = step.select(F.col("node").alias("to"), F.col("to").alias("far"))
        step = materialize(step.join(hop, "to", "left").select("node", F.coalesce("far", "to").alias("to")), "hop")
        levels.append(step)
        left = step.select(F.col("node").alias("a"), F.col("to").alias("ra"))
        right = step.select(F.col("node").alias("b"), F.col("to").alias("rb"))
        edges = edges.join(left, "a").join(right, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        edges = materialize(edges, "edges")
    if not levels:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # A later level only knows the groups that were still joined then: compose from the first on.
    # The least node of a component never moves, so the last label is the least node.
    out = levels[0].select("node", F.col("to").alias("root"))
    for level in levels[1:]:
        nxt = level.select(F.col("node").alias("root"), F.col("to").alias("up"))
        out = out.join(nxt, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    out = materialize(out, "roots")
    drop_tables(spark, mark, keep=1)
    return out
