"""Pareto fronts and the choice of operating points on them.

Objectives are given as (column, "max" | "min"). A row is dominated when another
complete row is at least as good everywhere and better somewhere; rows equal on
all objectives stay together, rows with a missing objective are left out.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import finite
from ..session import cut_lineage
from .ordered import bucket_count, range_boundaries, row_index, with_bucket

Objective = tuple[str, str]


def _oriented(df: DataFrame, objectives: Sequence[Objective]) -> DataFrame:
    """Distinct complete objective tuples, oriented so that smaller is better."""
    cols = []
    ok = F.lit(True)
    for i, (name, way) in enumerate(objectives):
        c = F.col(name).cast("double")
        ok = ok & finite(name)
        cols.append((-c if way == "max" else c).alias(f"o{i}"))
    return df.where(ok).select(*cols).distinct()


def _rejoin(df: DataFrame, points: DataFrame, objectives: Sequence[Objective]) -> DataFrame:
    keyed = df.withColumns(
        {
            f"o{i}": (-F.col(n).cast("double") if way == "max" else F.col(n).cast("double"))
            for i, (n, way) in enumerate(objectives)
        }
    )
    names = [f"o{i}" for i in range(len(objectives))]
    return keyed.join(points.select(*names), names, "left_semi").drop(*names)


def pareto_front(df: DataFrame, objectives: Sequence[Objective]) -> DataFrame:
    if len(objectives) == 2:
        return _rejoin(df, _front_2d(_oriented(df, objectives)), objectives)
    return _rejoin(df, _front_nd(_oriented(df, objectives), len(objectives)), objectives)


def _front_2d(p: DataFrame) -> DataFrame:
    """Sorted by the first objective, a point stays if it beats every earlier second value.

    The running best is exact across range buckets: the best of all earlier buckets
    comes from a table with one row per bucket.
    """
    one = p.groupBy("o0").agg(F.min("o1").alias("o1"))
    b = with_bucket(one, "o0", range_boundaries(one, "o0", bucket_count(p)))
    before = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = b.groupBy("_bucket").agg(F.min("o1").alias("_m")).select(
        "_bucket", F.min("_m").over(before).alias("_carry")
    )
    local = Window.partitionBy("_bucket").orderBy("o0").rowsBetween(Window.unboundedPreceding, -1)
    j = b.withColumn("_seen", F.min("o1").over(local)).join(carry, ["_bucket"], "inner")
    best = F.least("_seen", "_carry")
    return j.where(best.isNull() | (F.col("o1") < best)).select("o0", "o1")


def _stairs(batches: Iterator[pd.DataFrame], names: list[str]) -> Iterator[pd.DataFrame]:
    """Points of one bucket no earlier point of it dominates; they come in lexicographic order.

    A point can only be dominated by one that sorts before it, and for three objectives it is so
    where the staircase of the other two, low to high, lies below it.
    """
    x, y = [], []  # corners: x rises, y falls
    front = np.empty((0, len(names)))
    for pdf in batches:
        points = pdf[names].to_numpy(dtype=float)
        keep = np.zeros(len(points), dtype=bool)
        if len(names) == 3:
            for i, (_, a, b) in enumerate(points.tolist()):
                k = bisect_right(x, a)
                if k and y[k - 1] <= b:
                    continue
                keep[i] = True
                start = bisect_left(x, a)
                stop = start
                while stop < len(y) and y[stop] >= b:
                    stop += 1
                x[start:stop], y[start:stop] = [a], [b]
        else:
            for i, row in enumerate(points):
                if not (front <= row).all(axis=1).any():
                    keep[i] = True
                    front = np.vstack([front, row])
        yield pdf[keep]


def _left_of(rows: DataFrame, place: str, levels: int, by: list[str]) -> DataFrame:
    """``rows`` once for each level of a binary tree over ``place``, as source (left half of a block) or target (right half).

    A source of a smaller place than a target shares just one block with it. ``src`` and ``dst`` are kept where they hold.
    """
    pairs = F.explode(F.sequence(F.lit(0), F.lit(max(levels, 1) - 1))).alias("_level")
    dealt = rows.select("*", pairs) if levels else rows.withColumn("_level", F.lit(0)).where("false")
    right = F.expr(f"shiftright({place}, _level) & 1") == 1
    block = F.expr(f"shiftright({place}, _level + 1)")
    out = dealt.withColumns({"src": F.col("src") & ~right, "dst": F.col("dst") & right, "_block": block}).where("src OR dst")
    depth = len(by) // 2
    return out.withColumnsRenamed({"_level": f"_l{depth}", "_block": f"_b{depth}"}).drop(place)


def _levels(n: int) -> int:
    """Levels of a binary tree over places 0 to n - 1."""
    return max(0, n - 1).bit_length()


def _beaten(rows: DataFrame, names: list[str], dims: list[str], by: list[str]) -> DataFrame:
    """Targets (``names``) with a source of their group ``by`` that is no worse on every one of ``dims``."""
    first, rest = dims[0], dims[1:]
    if len(rest) > 1:
        # Sources with a smaller value meet targets over the tree of its distinct values, those with an equal one in its own block.
        values = row_index(rows.select(first).distinct(), first, "_place")
        placed = cut_lineage(rows.join(values, first), "placed")
        depth = len(by) // 2
        smaller = _left_of(placed, "_place", _levels(values.count()), by)
        equal = placed.withColumns({f"_l{depth}": F.lit(-1), f"_b{depth}": F.col("_place")}).drop("_place")
        return _beaten(smaller.unionByName(equal), names, rest, [*by, f"_l{depth}", f"_b{depth}"])
    last = rest[0]
    rows = cut_lineage(rows, "levels")
    b = with_bucket(rows, first, range_boundaries(rows, first, bucket_count(rows)))
    low = F.when(F.col("src"), F.col(last))
    # The staircase of a group: the least last value up to each first one, carried over range buckets.
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = b.groupBy(*by, "_bucket").agg(F.min(low).alias("_m")).withColumn("_carry", F.min("_m").over(before)).drop("_m")
    carry = cut_lineage(carry, "carry")
    inside = Window.partitionBy(*by, "_bucket").orderBy(first).rangeBetween(Window.unboundedPreceding, 0)
    seen = b.withColumn("_seen", F.min(low).over(inside)).join(carry, [*by, "_bucket"])
    return seen.where(F.col("dst") & (F.least("_seen", "_carry") <= F.col(last))).select(*names).distinct()


def _front_nd(p: DataFrame, k: int) -> DataFrame:
    """Fronts of range buckets first, then all of them against the staircases of earlier buckets.

    Rows are dealt in lexicographic order, so that a point is dominated only from its own or an
    earlier bucket. Its bucket's front is found where it lies; earlier buckets are met over a binary tree of
    buckets, whose every level is one running minimum. Nothing passes through the driver, and a front that holds
    every row costs a row for each level.
    """
    names = [f"o{i}" for i in range(k)]
    buckets = bucket_count(p)
    dealt = p.repartitionByRange(buckets, *names).sortWithinPartitions(*names).withColumn("_place", F.spark_partition_id())
    schema = ", ".join(f"{n} double" for n in names) + ", _place int"
    left = cut_lineage(dealt.mapInPandas(lambda batches: _stairs(batches, names), schema), "front")
    both = left.withColumns({"src": F.lit(True), "dst": F.lit(True)})
    beaten = _beaten(_left_of(both, "_place", _levels(buckets), []), names, names[1:], ["_l0", "_b0"])
    return left.select(*names).join(beaten, names, "left_anti")


def pick_point(front: DataFrame, best: Objective, within: Column | None = None, tie: str | None = None) -> DataFrame:
    """The row of a front that is best on one objective among those inside a constraint."""
    f = front if within is None else front.where(within)
    name, way = best
    key = -F.col(name) if way == "max" else F.col(name)
    order = F.struct(key.alias("k"), *([F.col(tie)] if tie else []))
    row = F.struct(*[F.col(c) for c in front.columns])
    return f.agg(F.min_by(row, order).alias("r")).where(F.col("r").isNotNull()).select("r.*")


def tercile(df: DataFrame, value: str, id_col: str, out: str = "tercile") -> DataFrame:
    """1, 2 or 3 by rank of the value; the first parts take the remainder rows."""
    indexed = row_index(df, value, "_i", ties=[F.col(id_col)])
    n = df.count()
    size, extra = divmod(n, 3)
    first, second = size + (extra > 0), 2 * size + (extra > 0) + (extra > 1)
    part = F.when(F.col("_i") < first, F.lit(1)).when(F.col("_i") < second, F.lit(2)).otherwise(F.lit(3))
    return indexed.withColumn(out, part).drop("_i")
