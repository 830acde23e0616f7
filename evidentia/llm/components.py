"""Connected components of an edge table by min-label hooking, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import cut


def _rooted(labels: DataFrame, max_rounds: int) -> DataFrame:
    """``labels(node, l)`` whose labels point on to smaller ones, followed to their ends."""
    for _ in range(max_rounds):
        jump = labels.select(F.col("node").alias("via"), F.col("l").alias("to"))
        moved = cut(labels.join(jump, labels.l == jump.via).select("node", "to", (F.col("to") != F.col("l")).alias("on")))
        labels = moved.select("node", F.col("to").alias("l"))
        if not moved.where("on").limit(1).count():
            return labels
    raise RuntimeError(f"labels did not settle in {max_rounds} rounds")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` of longs -> ``(node, component)``, component the smallest node reachable.

    Edges may be repeated, reversed or loops.  Nodes without an edge are not listed.  Every round
    gives each node the smallest node next to it (``min`` with map-side combining, so a hub costs
    no task more than its share), follows labels to their ends, and goes on with the different
    edges between labels that are left: an edge is joined in the rounds until its ends meet, not in
    all.  A round ends in a checkpoint.  An empty input gives an empty result.
    """
    pairs = cut(edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    levels: list[DataFrame] = []
    for _ in range(max_rounds):
        ends = pairs.select(F.col("a").alias("node"), "b").unionByName(pairs.select(F.col("b").alias("node"), "b"))
        labels = _rooted(cut(ends.groupBy("node").agg(F.min("b").alias("l"))), max_rounds)
        levels.append(labels)
        at = lambda c: labels.select(F.col("node").alias(f"_{c}"), F.col("l").alias(f"l{c}"))  # noqa: B023, E731
        open_ = pairs.where("a <> b").join(at("a"), F.col("a") == F.col("_a")).join(at("b"), F.col("b") == F.col("_b")).where("la <> lb")
        pairs = cut(open_.select(F.greatest("la", "lb").alias("a"), F.least("la", "lb").alias("b")).distinct())
        if not pairs.limit(1).count():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = levels[-1]
    for earlier in levels[-2::-1]:  # a label of an earlier round is a node of the next, or has met all it is connected to
        on = found.select(F.col("node").alias("via"), F.col("l").alias("to"))
        found = cut(earlier.join(on, earlier.l == on.via, "left").select("node", F.coalesce("to", "l").alias("l")))
    return found.select("node", F.col("l").alias("component"))
