"""Connected components by distributed union-find: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiffin.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (a, b). Large: every larger neighbour of a vertex moves to the smallest
    neighbour or the vertex itself; small: the vertex and its smaller neighbours move to the smallest of them."""
    if large:
        out = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        out = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # The counts go out before the shuffle, and are read back so that a busy vertex can be split in the join.
    least = written(out.groupBy("a").agg(F.min("b").alias("_low")))
    least = least.select(F.col("a").alias("_a"), F.least("a", "_low").alias("_low"))
    joined = out.join(least, F.col("a") == F.col("_a"))
    if large:
        moved = joined.filter("b > a").select(F.col("b").alias("a"), F.col("_low").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("_low").alias("b")).unionByName(
            least.select(F.col("_a").alias("a"), F.col("_low").alias("b"))
        )
    return written(moved.filter("a <> b").distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b): the smallest id reachable. Other ids are not listed.

    Both ends have one orderable type; links with a null end and of an id with itself are left out. The number
    of rounds grows with the logarithm of the longest path; every round reads what the last one wrote. The rounds are
    written as files and not as checkpoints, which keep the estimated size of their plan: a join's is the product of
    its sides', so its digits would double with every star until the driver's memory ends.
    """
    edges = written(links.select("a", "b").filter("a <> b").distinct())
    state = _state(edges)
    while state[0]:
        edges = _star(_star(edges, True), False)
        last, state = state, _state(edges)
        if state == last:
            break
    tips = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return written(tips.unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct())
