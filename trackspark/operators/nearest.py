"""The measurement of a group that needs the smallest window of a state, found without making the pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions.expr import finite

#: Measurements and states that one task takes together, about; most parts along a coordinate.
BLOCK, STATES, PARTS = 1 << 16, 1 << 18, 256
#: Points of a leaf, and states that are searched at once.
LEAF, BATCH = 8, 1 << 14
NONE = np.iinfo(np.int64).max


class Tree:
    """Points halved along both coordinates in turn; each node knows its box and its lowest id."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ids: np.ndarray):
        depth = max(0, int(np.ceil(np.log2(max(1, len(x)) / LEAF))))
        # Filled up with copies of the first point, which change no answer.
        at = np.concatenate([np.arange(len(x)), np.zeros((LEAF << depth) - len(x), dtype=np.int64)])
        for level in range(depth):
            node = np.arange(len(at)) // (len(at) >> level)
            at = at[np.lexsort(((x, y)[level % 2][at], node))]
        self.x, self.y, self.ids = x[at], y[at], ids[at]
        self.levels = []
        for level in range(depth + 1):
            px, py, pi = (v.reshape(1 << level, -1) for v in (self.x, self.y, self.ids))
            self.levels.append((px.min(1), px.max(1), py.min(1), py.max(1), pi.min(1)))

    def _near(self, level, node, p0, p1, s0, s1):
        x0, x1, y0, y1, _ = self.levels[level]
        return np.maximum(np.maximum(np.maximum(x0[node] - p0, p0 - x1[node]), 0) / s0, np.maximum(np.maximum(y0[node] - p1, p1 - y1[node]), 0) / s1)

    def _far(self, level, node, p0, p1, s0, s1):
        x0, x1, y0, y1, _ = self.levels[level]
        return np.maximum(np.maximum(np.abs(x0[node] - p0), np.abs(x1[node] - p0)) / s0, np.maximum(np.abs(y0[node] - p1), np.abs(y1[node] - p1)) / s1)

    def _leaf(self, node, p0, p1, s0, s1):
        at = node[:, None] * LEAF + np.arange(LEAF)
        d = np.maximum(np.abs(self.x[at] - p0[:, None]) / s0[:, None], np.abs(self.y[at] - p1[:, None]) / s1[:, None])
        least = d.min(1)
        return least, np.where(d == least[:, None], self.ids[at], NONE).min(1)

    def search(self, p0, p1, s0, s1):
        """Least distance and, of the points at it, the lowest id. Rounding keeps order, so bounds hold for computed distances too."""
        q = (p0, p1, s0, s1)
        last = len(self.levels) - 1
        node = np.zeros(len(p0), dtype=np.int64)
        for level in range(1, last + 1):
            a, b = self._near(level, 2 * node, *q), self._near(level, 2 * node + 1, *q)
            node = 2 * node + (b < a)
        best, _ = self._leaf(node, *q)
        row, node = np.arange(len(p0)), np.zeros(len(p0), dtype=np.int64)
        found = []
        for level in range(last + 1):
            if level:
                row, node = np.repeat(row, 2), np.repeat(2 * node, 2) + np.tile([0, 1], len(node))
            at = [v[row] for v in q]
            near = self._near(level, node, *at)
            keep = near <= best[row]
            row, node, near, at = row[keep], node[keep], near[keep], [v[keep] for v in at]
            # A node whose points are all equally far is an answer as it stands.
            flat = near == self._far(level, node, *at)
            found.append((row[flat], near[flat], self.levels[level][4][node[flat]]))
            np.minimum.at(best, row[flat], near[flat])
            row, node = row[~flat], node[~flat]
        found.append((row, *self._leaf(node, *[v[row] for v in q])))
        row, d, ids = (np.concatenate(v) for v in zip(*found, strict=True))
        order = np.lexsort((ids, d, row))
        row, first = np.unique(row[order], return_index=True)
        best, lowest = np.full(len(p0), np.inf), np.full(len(p0), -1, dtype=np.int64)
        best[row], lowest[row] = d[order][first], ids[order][first]
        return best, lowest


def _block(s: pa.Table, m: pa.Table, keys: list[str], schema: pa.Schema) -> pa.Table:
    if not s.num_rows or not m.num_rows:
        return schema.empty_table()
    read = lambda t, c: t.column(c).to_numpy()
    tree = Tree(read(m, "x"), read(m, "y"), read(m, "measurement_id"))
    q = [read(s, c) for c in ("p0", "p1", "s0", "s1")]
    with np.errstate(over="ignore", invalid="ignore"):
        parts = [tree.search(*[v[k : k + BATCH] for v in q]) for k in range(0, s.num_rows, BATCH)]
    d, ids = (np.concatenate(v) for v in zip(*parts, strict=True))
    return pa.Table.from_arrays([*(s.column(k) for k in keys), pa.array(d), pa.array(ids)], schema=schema)


def _parted(m: DataFrame, group: list[str], side: str, root: bool, out: str) -> DataFrame:
    """``m`` with ``out``, the part of the group along ``side``: as many quantiles as make blocks of both parts (``root``) or of this one."""
    share = F.col("_n") / F.lit(float(BLOCK))
    wanted = F.least(F.ceil(F.sqrt(share) if root else share), F.lit(PARTS))
    sizes = m.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > BLOCK).select(*group, wanted.alias("_p"))
    cuts = [(i + 1) / PARTS for i in range(PARTS - 1)]
    edges = m.join(sizes, group).groupBy(*group, "_p").agg(F.percentile_approx(side, cuts, F.lit(4 * PARTS)).alias("_q"))
    below = F.size(F.filter("_q", lambda e: e < F.col(side)))
    part = F.when(F.col("_p").isNotNull(), F.floor(below * F.col("_p") / PARTS)).otherwise(0)
    return m.join(edges, group, "left").withColumn(out, part.cast("int")).drop("_p", "_q")


def nearest_in_group(states: DataFrame, points: DataFrame, group: list[str], keys: list[str]) -> DataFrame:
    """``keys``, ``d_max`` and ``measurement_id``: the least needed window over the points of the state's group, ties to the lowest id.

    ``max(|x - p0| / sqrt(S00), |y - p1| / sqrt(S11))``, without the second term for points that are flat; only finite ones count.
    Groups of more than ``BLOCK`` points are cut along both coordinates into blocks of about that many. A state goes to each block
    whose box is no farther than the farthest corner of its nearest one, and is searched there in a tree, so the
    work follows the rows and not the pairs.
    """
    flat = F.col("is_1d")
    m = points.where(finite("local0") & (flat | finite("local1"))).select(
        *group, "is_1d", F.col("local0").cast("double").alias("x"), F.when(flat, 0.0).otherwise(F.col("local1").cast("double")).alias("y"), F.col("measurement_id").cast("long").alias("measurement_id")
    )
    # Equal points differ by their id only.
    m = m.groupBy(*group, "is_1d", "x", "y").agg(F.min("measurement_id").alias("measurement_id"))
    kind = [*group, "is_1d"]
    m = _parted(_parted(m, kind, "x", True, "_i"), [*kind, "_i"], "y", False, "_j")
    box = [f(c).alias(f"{c}{i}") for c in "xy" for i, f in ((0, F.min), (1, F.max))]
    boxes = m.groupBy(*kind, "_i", "_j").agg(*box)
    boxes = boxes.groupBy(*group).agg(F.collect_list(F.struct("is_1d", "_i", "_j", "x0", "x1", "y0", "y1")).alias("_boxes"))

    root = lambda c: F.when((F.col(c) > 0) & ~F.isnan(c), F.sqrt(c))
    s = states.select(*group, *[k for k in keys if k not in group], F.col("pred_l0").alias("p0"), F.col("pred_l1").alias("p1"), root("S00").alias("s0"), root("S11").alias("s1"))
    s = s.where(finite("p0") & F.col("s0").isNotNull())
    whole = finite("p1") & F.col("s1").isNotNull()
    p0, p1, s0, s1 = F.col("p0"), F.col("p1"), F.col("s0"), F.col("s1")
    gap = lambda lo, hi, p: F.greatest(lo - p, p - hi, F.lit(0.0))
    span = lambda lo, hi, p: F.greatest(F.abs(lo - p), F.abs(hi - p))

    def reach(b: Column, of) -> Column:
        first = of(b.x0, b.x1, p0) / s0
        return F.when(b.is_1d, first).otherwise(F.greatest(first, of(b.y0, b.y1, p1) / s1))

    s = s.join(boxes, group).withColumn("_boxes", F.filter("_boxes", lambda b: b.is_1d | whole))
    s = s.withColumn("_most", F.array_min(F.transform("_boxes", lambda b: reach(b, span))))
    s = s.withColumn("_b", F.explode(F.filter("_boxes", lambda b: reach(b, gap) <= F.col("_most"))))
    for_flat = lambda c, other: F.when(F.col("_b.is_1d"), F.lit(other)).otherwise(F.col(c)).alias(c)
    s = s.select(*group, *[k for k in keys if k not in group], "_b.is_1d", "_b._i", "_b._j", "p0", for_flat("p1", 0.0), "s0", for_flat("s1", 1.0))

    block = [*kind, "_i", "_j"]
    chunks = s.groupBy(*block).agg(F.ceil(F.count(F.lit(1)) / STATES).alias("_chunks"))
    s = s.join(chunks, block).withColumn("_chunk", F.pmod(F.xxhash64(*keys), F.col("_chunks"))).drop("_chunks")
    m = m.join(chunks, block).withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1))).drop("_chunks")
    made = StructType([*(StructField(k, states.schema[k].dataType) for k in keys), StructField("d_max", DoubleType()), StructField("measurement_id", LongType())])
    arrow = to_arrow_schema(made)
    # Both sides descend from the same rows; Spark wants the keys of a cogroup to be columns of their own.
    key = [f"_g{i}" for i in range(len(block) + 1)]
    types = {f.name: f.dataType for f in s.schema}
    keyed = lambda d: d.withColumns({k: F.col(c).cast(types[c]) for k, c in zip(key, [*block, "_chunk"], strict=True)})
    left = keyed(s).select(*key, *keys, "p0", "p1", "s0", "s1")
    right = keyed(m).select(*key, "x", "y", "measurement_id")
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(lambda a, b: _block(a, b, keys, arrow), made)
    best = found.where(finite("d_max")).groupBy(*keys).agg(F.min(F.struct("d_max", "measurement_id")).alias("_b"))
    return best.select(*keys, "_b.d_max", "_b.measurement_id")
