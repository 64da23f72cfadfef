"""Connected components by alternating large and small stars, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b of one orderable type): root is the least node of
    its component, and its own root.

    Repeated edges, either direction and loops are fine; edges with a null are ignored; a node that has only a
    loop is left out. Each round joins edges with a minimum per node (a hub's minimum is combined before the
    shuffle, and a skewed join can be split), and is written to the shared folder.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, path = common.stored(edges, "edges")
    before = None
    while True:
        sign = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.hash("v", "u").cast("long"))).first()
        if sign == before or not sign[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v")).distinct()
        before = sign
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large, between = common.stored(large, "edges")
        least = _least(large)
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges, after = common.stored(small.union(least).distinct(), "edges")
        for old in (path, between):  # the new edges are whole, and nothing reads these again
            common.remove(old)
        path = after
