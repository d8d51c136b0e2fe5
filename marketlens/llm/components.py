"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a minimum per node and a join; no node's neighbours are ever gathered, so a hub with
very many neighbours splits like any hot join key. Every step is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import freed, stored


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node with the smallest of the node and its neighbours."""
    near = _both_ways(edges)
    least = near.groupBy("a").agg(F.min("b").alias("least"))
    least = least.select("a", F.least("a", "least").alias("least"))
    return near.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours with the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    moved = down.join(least, "a").filter("b > least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.select("a", F.col("least").alias("b")))


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` (its smallest node) for all nodes of the edges ``a, b``.

    Loops are allowed and their nodes belong to a component; null ends are not allowed.
    """
    alone = edges.filter("a = b").select(F.col("a").alias("node")).distinct()
    current = stored(edges.filter("a != b").select("a", "b").distinct(), "edges")
    mark = _fingerprint(current)
    while True:
        old, current = current, stored(_small_star(_large_star(current).filter("a != b")).distinct(), "stars")
        freed(old)
        after = _fingerprint(current)
        if after == mark:
            break
        mark = after
    found = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component"))
    lone = alone.select("node", F.col("node").alias("component"))
    return found.unionByName(roots).unionByName(lone).groupBy("node").agg(F.min("component").alias("component"))


def merged_components(comps: DataFrame, links: DataFrame) -> DataFrame:
    """``node, component`` after further links ``a, b``, which join whole components: only these are worked through."""
    if links.isEmpty():
        return comps
    by_comp = links
    for end in ("a", "b"):
        own = comps.select(F.col("node").alias(end), "component")
        by_comp = by_comp.join(own, end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
    joined = stored(connected_components(by_comp), "joined").toDF("component", "joined")
    old = comps.join(joined, "component", "left").select("node", F.coalesce("joined", "component").alias("component"))
    new = joined.join(comps.select(F.col("node").alias("component")), "component", "left_anti").toDF("node", "component")
    return stored(old.unionByName(new), "components")


def _fingerprint(edges: DataFrame) -> tuple:
    low = F.xxhash64("a", "b") % (1 << 31)
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(low), F.sum(F.xxhash64("b", "a") % (1 << 31))).first())
