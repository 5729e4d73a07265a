"""Connected components of a link table by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolefit.llm._work import staged


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def connected_components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, component) for every end of a link; component: the smallest node reachable.

    `links` has longs `a` and `b`, in any order, repeats allowed; nulls and self-links are ignored. An empty table gives an empty one.
    Every round is two joins on a node with its smallest neighbour, so work is spread by node and hot
    nodes are ordinary skewed joins; the number of rounds grows with the logarithm of the diameter.
    With `rounds`, it stops after so many: equal components are then connected, but not all connected nodes have one component.
    """
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before, done = (1,) if rounds else _checksum(edges), 0
    while before[0]:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        edges, done = staged(small, "edges"), done + 1
        if done == rounds:
            break
        after = _checksum(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(roots.join(edges.select(F.col("u").alias("node")).hint("merge"), "node", "left_anti").select("node", F.col("node").alias("component")))
