"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in `links` (a, b): the smallest id reachable. Both ends must not be null.

    In each round every node moves to the least of itself and its neighbours, and a link between two nodes becomes one
    between their new places; links within a place vanish. Least is by id in every other round, which ends stars at once,
    and by a hash of the round and the id otherwise, which shortens chains of any order by a part, so that the rounds
    grow with the logarithm of the nodes. No group is collected; nodes with many neighbours are pre-aggregated and split
    by the skew-aware join. An empty table gives an empty table.
    """
    edges = written(links.select("a", "b").where("a <> b").distinct(), "links")
    labels, turn = None, 0
    while True:
        both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")
        key = lambda c: F.struct(F.lit(0).alias("k") if turn % 2 == 0 else F.xxhash64(F.lit(turn), c).alias("k"), F.col(c).alias("id"))  # noqa: B023, E731
        moved = written(both.groupBy("u").agg(F.min(key("v")).alias("v")).select("u", F.least("v", key("u"))["id"].alias("to")), "moved")
        step = moved.select(F.col("u").alias("component"), "to")
        if labels is None:
            labels = step.select(F.col("component").alias("id"), F.col("to").alias("component"))
        else:
            labels = written(labels.join(step.hint("merge"), "component", "left").select("id", F.coalesce("to", "component").alias("component")), "labels")
        ends = [moved.select(F.col("u").alias(end), F.col("to").alias(to)).hint("merge") for end, to in (("a", "x"), ("b", "y"))]
        next_edges = edges.join(ends[0], "a").join(ends[1], "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        edges = written(next_edges.distinct(), "links")
        turn += 1
        if edges.isEmpty():
            # Written, so that the join below can split a component that is one hot key.
            least = written(labels.groupBy("component").agg(F.min("id").alias("least")), "least")
            return labels.join(least.hint("merge"), "component").select("id", F.col("least").alias("component"))
