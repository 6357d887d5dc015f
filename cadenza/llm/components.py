"""Connected components of a graph of links, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shards as S


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for each node of the links, one node of its component, the same for all.

    In each round every node goes to its smallest neighbour if that is smaller
    than itself, and links between what the nodes have become are kept.  Nodes are
    hashed, so chains in order of id don't arise, and the rounds grow with the
    logarithm of the links.  Nothing but the count of links left reaches the driver.
    """
    now = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    edges = S.kept(now.union(now.select("v", "u")).distinct())
    names = None
    while edges.take(1):
        moved = S.kept(edges.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("to")))
        if names is None:
            names = moved.withColumnsRenamed({"u": "node", "to": "root"})
        else:
            step = moved.withColumnsRenamed({"u": "root"})
            names = names.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        names = S.kept(names)
        ends = moved.withColumnsRenamed({"u": "v", "to": "v2"})
        edges = edges.join(moved, "u").select(F.col("to").alias("u2"), "v").join(ends, "v").where("u2 <> v2")
        edges = S.kept(edges.select(F.col("u2").alias("u"), F.col("v2").alias("v")).distinct())
    if names is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return names
