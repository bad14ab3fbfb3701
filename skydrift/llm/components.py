"""Connected components of an edge list, without collecting a neighbourhood anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored


def _hang_on_least(edges: DataFrame, only_smaller: bool) -> DataFrame:
    """Every neighbour of a node (all larger ones, or all smaller ones and the node) hangs on the least of them."""
    both = edges.where("a <> b")
    both = both.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")) if only_smaller else both.select(F.col("a").alias("u"), F.col("b").alias("v")).union(both.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    moved = both.join(least, "u")
    if only_smaller:
        out = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
    else:
        out = moved.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label``, the least node of its component, for every node of the edges ``a``, ``b`` but the labels themselves.

    Alternates two star contractions until every node hangs on its label; the
    number of rounds grows with the logarithm of the longest path. Each round is an
    aggregation that combines before its shuffle and an equi-join.
    """
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
    edges = stored(edges.select("a", "b").where("a <> b").distinct(), "edges")
    last = None
    while last != (now := mark(edges)) and now[0]:
        last = now
        edges = stored(_hang_on_least(_hang_on_least(edges, False), True), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
