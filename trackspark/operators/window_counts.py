"""Measurements in each state's window, counted and searched without making the pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.expr import finite
from ..functions.geometry import half_width

STATE = ("event_id", "track_nr", "state_idx")
SURFACE = ("event_id", "geometry_id")
#: Slices of a surface along its first coordinate, from which blocks are made.
SLICES = 4096
#: Measurements and states that one task takes together, about.
BLOCK, STATES = 1 << 16, 1 << 18


class Ranked:
    """Points in the order of one coordinate, the other one as codes: ranges of both are counted and searched.

    Level ``j`` keeps the codes of every run of ``2**j`` points in order, so that a range of
    points is a few runs and each takes two binary searches.
    """

    def __init__(self, codes: np.ndarray, width: int):
        n = len(codes)
        self.width = np.int64(max(width, 1))
        self.top = int(n).bit_length()
        at = np.arange(n, dtype=np.int64)
        self.levels = [np.sort((at >> j) * self.width + codes) for j in range(self.top + 1)]

    def _node(self, j: int, node, c, d):
        keys = self.levels[j]
        base = node * self.width
        return np.searchsorted(keys, base + d) - np.searchsorted(keys, base + c)

    def count(self, start, stop, c, d):
        """Points ``start <= i < stop`` with ``c <= code < d``, for each entry of the arrays."""
        out = np.zeros(len(start), dtype=np.int64)
        left, right = start.astype(np.int64), np.maximum(stop, start).astype(np.int64)
        for j in range(self.top + 1):
            for side in (0, 1):
                edge = left if side == 0 else right
                odd = np.flatnonzero((left < right) & (edge & 1 == 1) & (c < d))
                if len(odd):
                    node = left[odd] if side == 0 else right[odd] - 1
                    out[odd] += self._node(j, node, c[odd], d[odd])
                    edge[odd] += 1 if side == 0 else -1
            left, right = left >> 1, right >> 1
        return out

    def _select(self, k, c, d):
        """Place of the ``k``-th point with a code in the range; where there is none, a place after those that are."""
        node = np.zeros(len(k), dtype=np.int64)
        k = k.copy()
        for j in range(self.top - 1, -1, -1):
            node <<= 1
            here = self._node(j, node, c, d)
            beyond = k >= here
            k -= np.where(beyond, here, 0)
            node += beyond
        return node

    def first(self, start, stop, c, d):
        """First such point, or -1."""
        at = self._select(self.count(np.zeros_like(start), start, c, d), c, d)
        return np.where((at >= start) & (at < stop) & (c < d), at, -1)

    def last(self, start, stop, c, d):
        """Last such point, or -1."""
        before = self.count(np.zeros_like(stop), stop, c, d)
        at = self._select(np.maximum(before - 1, 0), c, d)
        return np.where((before > 0) & (at >= start) & (at < stop) & (c < d), at, -1)


def _reach(values: np.ndarray, centre: np.ndarray, width: np.ndarray):
    """Range of the ascending ``values`` with ``|value - centre| <= width``, by that very test."""
    n = len(values)
    with np.errstate(invalid="ignore"):
        lo, hi = np.searchsorted(values, centre - width), np.searchsorted(values, centre + width, side="right")
        padded = np.concatenate([values, [np.inf]])
        # The ends above are rounded: step to where the test itself changes.
        while (m := (lo > 0) & (centre - values[np.maximum(lo - 1, 0)] <= width)).any():
            lo = lo - m
        while (m := (lo < n) & (centre - padded[lo] > width)).any():
            lo = lo + m
        while (m := (hi < n) & (padded[hi] - centre <= width) & (hi < n)).any():
            hi = hi + m
        while (m := (hi > 0) & (values[np.maximum(hi - 1, 0)] - centre > width)).any():
            hi = hi - m
    none = np.isnan(centre) | np.isnan(width)
    return np.where(none, 0, lo), np.where(none, 0, np.maximum(hi, lo))


def _block(s: pd.DataFrame, m: pd.DataFrame, tolerance: float) -> pd.DataFrame:
    """Counts and nearest accepted measurement of the states ``s`` among the measurements ``m``."""
    n_window = np.zeros(len(s), dtype=np.int64)
    best_d, best_id = np.full(len(s), np.inf), np.full(len(s), -1, dtype=np.int64)
    col = lambda c: s[c].to_numpy(dtype=float, na_value=np.nan)
    flat = m["is_1d"].to_numpy(dtype=bool)
    for one_d in (True, False):
        part = m[flat == one_d].sort_values(["local0", "measurement_id"])
        if not len(part):
            continue
        x, ids = part["local0"].to_numpy(dtype=float), part["measurement_id"].to_numpy()
        ux, begin = np.unique(x, return_index=True)
        begin = np.append(begin, len(x))
        uy, code = (np.zeros(1), np.zeros(len(x), dtype=np.int64)) if one_d else np.unique(part["local1"].to_numpy(dtype=float), return_inverse=True)
        points = Ranked(code.astype(np.int64), len(uy))
        lo, hi = _reach(ux, col("pred_l0"), col("w0"))
        c, d = (np.zeros(len(s), dtype=np.int64), np.ones(len(s), dtype=np.int64)) if one_d else _reach(uy, col("pred_l1"), col("w1"))
        n_window += points.count(begin[lo], begin[hi], c, d)
        # Accepted positions: the same window, cut to the tolerance around them.
        at = np.flatnonzero(np.isfinite(col("sel_l0")) & (lo < hi) & (c < d))
        if not len(at):
            continue
        sel0, sel1 = col("sel_l0")[at], col("sel_l1")[at]
        near = _reach(ux, sel0, np.full(len(at), tolerance))
        lo, hi, c, d = np.maximum(lo[at], near[0]), np.minimum(hi[at], near[1]), c[at], d[at]
        hi = np.maximum(hi, lo)
        if not one_d:
            close, known = _reach(uy, sel1, np.full(len(at), tolerance)), np.isfinite(sel1)
            c, d = np.where(known, np.maximum(c, close[0]), c), np.where(known, np.minimum(d, close[1]), d)
        mid = np.clip(np.searchsorted(ux, sel0), lo, hi)
        level = np.searchsorted(begin, np.arange(len(x)), side="right") - 1  # of each point, its distinct value
        for step, found in ((1, points.first(begin[mid], begin[hi], c, d)), (-1, points.last(begin[lo], begin[mid], c, d))):
            row = np.flatnonzero(found >= 0)
            u = level[found[row]]
            dist = np.abs(ux[u] - sel0[row])
            # Distinct values can be equally far after rounding; the lowest id among all of them counts.
            while len(row):
                one = points.first(begin[u], begin[u + 1], c[row], d[row])
                hit = one >= 0
                r, dd, ii = at[row[hit]], dist[hit], ids[one[hit]]
                less = (dd < best_d[r]) | ((dd == best_d[r]) & (ii < best_id[r]))
                best_d[r[less]], best_id[r[less]] = dd[less], ii[less]
                u = u + step
                inside = (u >= lo[row]) & (u < hi[row])
                same = inside & (np.abs(ux[np.clip(u, 0, len(ux) - 1)] - sel0[row]) == dist)
                row, u, dist = row[same], u[same], dist[same]
    out = s[list(STATE)].copy()
    out["n_window"], out["d0"], out["cand_hit_id"] = n_window, best_d, best_id
    return out[(n_window > 0)]


def count_in_windows(states: DataFrame, measurements: DataFrame, n: float, tolerance: float) -> DataFrame:
    """Per state with any: ``n_window`` measurements in the window and ``_sel_id``, the accepted one.

    For states that carry their own covariance. A surface is cut along its first coordinate into blocks
    of about ``BLOCK`` measurements (by id where one value has more), a state goes to
    the blocks that its window meets, and what the blocks find is added up. The work grows with the rows, not the pairs.
    """
    m = measurements.select(
        *SURFACE, F.col("measurement_id").cast("long").alias("measurement_id"), "local0", "local1", F.coalesce(F.col("var_local1") <= 0, F.lit(True)).alias("is_1d")
    ).where(finite("local0") & (F.col("is_1d") | finite("local1")))
    sides = m.groupBy(*SURFACE).agg(F.min("local0").alias("_lo"), F.max("local0").alias("_hi"))
    part = F.coalesce(F.try_divide(F.col("local0") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    m = m.join(sides, list(SURFACE)).withColumn("_slice", F.least(F.floor(part * SLICES), F.lit(SLICES - 1))).drop("_lo", "_hi")
    slices = m.groupBy(*SURFACE, "_slice").agg(F.count(F.lit(1)).alias("_n"), F.min("local0").alias("_from"), F.max("local0").alias("_to"))
    before = Window.partitionBy(*SURFACE).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("_block", F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / BLOCK))
    blocks = slices.groupBy(*SURFACE, "_block").agg(F.sum("_n").alias("_n"), F.min("_from").alias("_from"), F.max("_to").alias("_to"))
    blocks = blocks.withColumn("_salts", F.ceil(F.col("_n") / (2 * BLOCK))).drop("_n")

    wide = lambda i: F.nanvl(half_width(f"S{i}{i}", n), F.lit(float("inf"))).alias(f"w{i}")
    s = states.where(finite("pred_l0") & F.col("S00").isNotNull()).select(*STATE, "geometry_id", "pred_l0", "pred_l1", "sel_l0", "sel_l1", wide(0), wide(1))
    # A hair more than the window, so that rounding never loses a block.
    slack = F.col("w0") + (F.abs("pred_l0") + F.col("w0")) * 1e-9 + 1e-12
    s = s.join(blocks, list(SURFACE)).where((F.col("pred_l0") + slack >= F.col("_from")) & (F.col("pred_l0") - slack <= F.col("_to"))).drop("_from", "_to")
    groups = s.groupBy(*SURFACE, "_block", "_salts").agg(F.ceil(F.count(F.lit(1)) / STATES).alias("_chunks"))
    chunk = F.pmod(F.xxhash64(*STATE), F.col("_chunks")).alias("_chunk")
    each = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.col(k) - 1))
    key = [*SURFACE, "_block", "_salt", "_chunk"]
    s = s.join(groups.drop("_salts"), [*SURFACE, "_block"]).withColumn("_chunk", chunk).withColumn("_salt", each("_salts")).drop("_salts", "_chunks")
    dealt = slices.select(*SURFACE, "_slice", "_block").join(groups, [*SURFACE, "_block"])
    m = m.join(dealt, [*SURFACE, "_slice"]).withColumn("_salt", F.pmod(F.xxhash64("measurement_id"), F.col("_salts")))
    m = m.withColumn("_chunk", each("_chunks")).drop("_slice", "_salts", "_chunks")
    # Both sides descend from the blocks; Spark wants the keys of a cogroup to be columns of their own.
    m = m.withColumn("_block", F.col("_block") + F.lit(0))

    types = {f.name: f.dataType.simpleString() for f in states.schema.fields}
    schema = ", ".join([*(f"{k} {types[k]}" for k in STATE), "n_window long", "d0 double", "cand_hit_id long"])
    found = (
        s.groupBy(*key)
        .cogroup(m.groupBy(*key))
        .applyInPandas(lambda a, b: _block(a, b, tolerance), schema)
    )
    picked = F.min(F.when(F.col("cand_hit_id") >= 0, F.struct("d0", "cand_hit_id"))).getField("cand_hit_id")
    return found.groupBy(*STATE).agg(F.sum("n_window").alias("n_window"), picked.alias("_sel_id"))
