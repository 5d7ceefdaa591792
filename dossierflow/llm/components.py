"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierflow.llm.store import keep

#: each round leaves about half of the nodes of a component or fewer, so this covers any table
ROUNDS = 128


def _order(node: str, k: int):
    """Nodes in another order each round, so that no long chain follows it."""
    return F.xxhash64(F.lit(k), node)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b): the smallest node it is connected with.

    Each round hangs every node on the first of its neighbours and itself in an order of that
    round, which is an aggregate that combines before its shuffle, and goes on with the distinct
    edges between those that something hangs on. Rounds therefore shrink; a node with many
    neighbours costs its edges once. When no edge is left the rounds are followed backwards.
    Self loops keep a node alone, an empty table gives no rows. Nothing but a question whether
    edges are left reaches the driver.
    """
    ends = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    left = keep(edges.select("a", "b").distinct(), "edges")
    hung: list[DataFrame] = []
    for k in range(ROUNDS):
        first = F.min_by("b", _order("b", k))
        best = left.select(F.inline(ends)).groupBy("a").agg(first.alias("b"))
        own = F.when(_order("a", k) < _order("b", k), F.col("a")).otherwise(F.col("b"))
        hung.append(keep(best.select(F.col("a").alias("node"), own.alias("next")), "hung"))
        step = hung[-1]
        left = keep(
            left.join(step.select(F.col("node").alias("a"), F.col("next").alias("x")), "a")
            .join(step.select(F.col("node").alias("b"), F.col("next").alias("y")), "b")
            .where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct(),
            "edges",
        )
        if left.isEmpty():
            break
    else:
        raise RuntimeError("edges were left")
    # roots, backwards: what hangs on a node has that node's root
    root = hung.pop()
    while hung:
        step = hung.pop()
        above = root.select(F.col("node").alias("next"), F.col("next").alias("top"))
        root = keep(
            step.join(above, "next", "left").select("node", F.coalesce("top", "next").alias("next")), "roots"
        )
    least = root.groupBy("next").agg(F.min("node").alias("label"))
    return keep(root.join(least, "next").select("node", "label"), "labels")
