"""Connected components inside groups, by alternating stars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, discard


def _large_star(edges: DataFrame, by: list[str]) -> DataFrame:
    """Larger neighbours of a node move to the smallest node around it."""
    around = edges.union(edges.select(*by, F.col("b").alias("a"), F.col("a").alias("b")))
    # Stored, so that a node with very many neighbours can be dealt over several tasks in the join.
    least = cut_lineage(around.groupBy(*by, "a").agg(F.least(F.col("a"), F.min("b")).alias("least")), "least")
    return around.join(least, [*by, "a"]).where("b > a").select(*by, F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(edges: DataFrame, by: list[str]) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them."""
    least = cut_lineage(edges.groupBy(*by, "a").agg(F.min("b").alias("least")), "least")
    moved = edges.join(least, [*by, "a"]).where("b <> least").select(*by, F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.union(least.select(*by, "a", F.col("least").alias("b")))


def components(edges: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    """``by``, ``node`` and ``component`` (the smallest node reached) of all nodes of ``edges``, inside each group.

    The number of rounds grows with the logarithm of a component's width; each is written to the shared
    folder and the one before it deleted. Only a count and a checksum come to the driver.
    """
    by = list(by)
    low, high = F.least(a, b), F.greatest(a, b)
    links = edges.where(F.col(a) != F.col(b)).select(*by, high.alias("a"), low.alias("b")).distinct()
    links = cut_lineage(links, "links")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*by, "a", "b"))).first())

    now = mark(links)
    while now[0]:
        larger = cut_lineage(_large_star(links, by).distinct(), "links")
        smaller = cut_lineage(_small_star(larger, by).distinct(), "links")
        discard(links)
        discard(larger)
        links = smaller
        before, now = now, mark(links)
        if before == now:
            break
    own = links.select(*by, F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(*by, F.col("a").alias("node"), F.col("b").alias("component")).union(own)
