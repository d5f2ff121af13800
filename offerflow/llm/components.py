"""Connected components of a graph whose edges are a DataFrame, by contraction.

In each round every node is merged into the first of itself and its neighbours,
and edges are taken between what is left, until there are none. Which node comes
first is as good as random, so that the number of rounds is logarithmic; a star or
a dense group takes one. Minima are taken before rows meet, and the moves of a round are a
table of their own: the planner broadcasts a small one and splits the hot keys of a
large one, so that a hub with a third of all edges is not one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

MOST_ROUNDS = 100


def _contract(edges: DataFrame, moves: DataFrame) -> DataFrame:
    """The edges between the nodes that others moved to, without loops."""
    for end in ("u", "v"):
        to = moves.select(F.col("node").alias("_of"), F.col("to").alias("_to"))
        edges = edges.join(to, F.col(end) == F.col("_of")).withColumn(end, F.col("_to")).drop("_of", "_to")
    return edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(edges: DataFrame, rank=F.xxhash64) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``u``, ``v``); ``root`` is one node of the component, the same for all of it.

    Loops and null ends count for nothing. No edges: no rows. ``rank`` gives a column
    by which nodes are ordered as if at random; a digest may be its own rank.
    """
    first = lambda c: F.struct(rank(F.col(c)).alias("rank"), F.col(c).alias("node"))
    edges = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    found = None
    for _ in range(MOST_ROUNDS):
        if edges.isEmpty():
            break
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("node")).agg(F.min(first("v")).alias("other"))
        moves = cut(least.select("node", F.least(F.col("other"), first("node"))["node"].alias("to")))
        if found is None:
            found = moves.withColumnRenamed("to", "root")
        else:
            then = moves.filter("node <> to").withColumnRenamed("node", "_of")
            found = found.join(then, F.col("root") == F.col("_of"), "left").select("node", F.coalesce("to", "root").alias("root"))
        edges = cut(_contract(edges, moves))
    else:
        raise RuntimeError(f"components are not complete after {MOST_ROUNDS} rounds")
    if found is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return found
