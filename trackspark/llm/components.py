"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, discard


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
    return both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them. Edges have a > b."""
    low = edges.groupBy("a").agg(F.min("b").alias("low"))
    down = edges.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b")
    return down.union(low.select("a", F.col("low").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def component_roots(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a and b, longs); root is the smallest node reachable.

    Large-star and small-star steps alternate until the table no longer changes; the
    number of rounds grows with the logarithm of the component size. Each round is
    written to the shared folder; only a count and a checksum come to the driver.
    Loops and links with a null end are ignored; repeated links count once.
    """
    edges = cut_lineage(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    state = _state(edges)
    while state[0]:
        smaller = cut_lineage(_small_star(_large_star(edges)), "links")
        discard(edges)
        edges = smaller
        before, state = state, _state(edges)
        if before == state:
            break
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
