"""Ordered computations that stay exact when one group holds most of the rows.

Two tools:

* :func:`running` / :func:`shifted` — per-group running values and neighbours.
  The integer order column cuts every group into chunks of ``width`` steps; rows
  are shuffled by group and chunk, and one row per chunk carries the values of
  earlier chunks over. There is one plan for every length of group. Its carry
  side is filtered by a scalar subquery (does any group pass its first chunk?)
  and stays empty otherwise, when adaptive execution drops the join to it.
* :func:`value_prefix` — running totals over a value-ordered table across the
  whole cluster, by range buckets with literal boundaries.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import col
from ..session import cut_lineage

CHUNK_WIDTH = 65_536
#: Floating-point values are added in this type, and their sums in the other; a sum of two of those keeps its places.
FIXED, FIXED_SUM = "decimal(27,14)", "decimal(37,14)"


#: Number of a row's chunk, kept from one call to the next by :func:`in_chunks`.
CHUNK = "_chunk"


def passes_chunk(df: DataFrame, order: str, width: int = CHUNK_WIDTH) -> Column:
    """Is any step outside the first chunk? A scalar subquery over the order column, answered when the plan runs.

    Take it from a table before it is grouped or joined and hand it to the calls on what comes of it.
    """
    outside = F.coalesce(F.max((F.col(order) >= width) | (F.col(order) < 0)), F.lit(False))
    return df.agg(outside.alias("outside")).scalar()


def in_chunks(df: DataFrame, keys: Sequence[str], order: str, width: int = CHUNK_WIDTH) -> DataFrame:
    """``df`` with the chunk of each row: calls in a row then share one shuffle. Drop ``CHUNK`` after the last.

    Rows with a null key are one group and one chunk, so the carry can be joined
    by plain equality, which keeps the rows where the windows have put them.
    """
    known = reduce(and_, [F.col(k).isNotNull() for k in keys])
    return df.withColumn(CHUNK, F.when(known, F.floor(F.col(order) / F.lit(width))).otherwise(F.lit(0)).cast("long"))


def _same(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & df[k].eqNullSafe(other[k])
    return cond


def _ready(df: DataFrame, keys: Sequence[str], order: str, width: int, passes: Column | None) -> tuple[DataFrame, Column, bool]:
    passes = passes_chunk(df, order, width) if passes is None else passes
    given = CHUNK in df.columns
    return (df if given else in_chunks(df, keys, order, width)), passes, given


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    *,
    sums: Mapping[str, Column | str] | None = None,
    mins: Mapping[str, Column | str] | None = None,
    lasts: Mapping[str, Column | str] | None = None,
    inclusive: bool = True,
    descending: bool = False,
    width: int = CHUNK_WIDTH,
    passes: Column | None = None,
) -> DataFrame:
    """Add running sums (0 on an empty frame), minima and last non-null values.

    ``order`` must be an integer that is unique within a group. With
    ``inclusive=False`` the frame ends before the current row; ``descending``
    runs it from the end of the group. Floating-point values are added as
    ``FIXED`` numbers, whose sums are exact: results are the same bits for every ``width``.
    A value that is infinite or does not fit is an error. ``passes`` is :func:`passes_chunk`
    of ``df`` or of a table it came from. A chunk column of ``df`` is used and kept.
    """
    sums, mins, lasts = dict(sums or {}), dict(mins or {}), dict(lasts or {})
    floating = [n for n, e in sums.items() if df.select(col(e).alias(n)).schema[0].dataType.simpleString() in ("float", "double")]
    sums |= {n: col(sums[n]).cast(FIXED) for n in floating}
    as_double = {n: F.col(n).cast("double") for n in floating}
    keys = list(keys)
    direction = F.col(order).desc() if descending else F.col(order).asc()
    end = 0 if inclusive else -1

    df, passes, keep_chunk = _ready(df, keys, order, width, passes)
    w = Window.partitionBy(*keys, CHUNK).orderBy(direction).rowsBetween(Window.unboundedPreceding, end)
    local = {n: F.coalesce(F.sum(col(e)).over(w), F.lit(0)) for n, e in sums.items()}
    local |= {n: F.min(col(e)).over(w) for n, e in mins.items()}
    local |= {n: F.last(col(e), ignorenulls=True).over(w) for n, e in lasts.items()}
    out = df.withColumns(local)
    aggs = [F.sum(col(e)).alias(f"_t_{n}") for n, e in sums.items()]
    aggs += [F.min(col(e)).alias(f"_t_{n}") for n, e in mins.items()]
    pick = F.min_by if descending else F.max_by
    for n, e in lasts.items():
        aggs.append(pick(col(e), F.when(col(e).isNotNull(), F.col(order))).alias(f"_t_{n}"))
    before = (
        Window.partitionBy(*keys)
        .orderBy(F.col(CHUNK).desc() if descending else F.col(CHUNK).asc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = df.where(passes).groupBy(*keys, CHUNK).agg(*aggs)
    carry = totals.select(
        *keys,
        CHUNK,
        *[F.sum(f"_t_{n}").over(before).alias(f"_c_{n}") for n in sums],
        *[F.min(f"_t_{n}").over(before).alias(f"_c_{n}") for n in mins],
        *[F.last(f"_t_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in lasts],
    )
    joined = out.join(carry, reduce(and_, [out[k] == carry[k] for k in (*keys, CHUNK)]), "left")
    kept_type = lambda n, c: c.cast(FIXED_SUM) if n in floating else c
    combined = {n: kept_type(n, F.col(n)) + kept_type(n, F.coalesce(F.col(f"_c_{n}"), F.lit(0))) for n in sums}
    combined |= {n: F.least(F.col(n), F.col(f"_c_{n}")) for n in mins}
    combined |= {n: F.coalesce(F.col(n), F.col(f"_c_{n}")) for n in lasts}
    kept = [combined.get(c, out[c]).alias(c) for c in out.columns if keep_chunk or c != CHUNK]
    return joined.select(*kept).withColumns(as_double)


def shifted(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    values: Mapping[str, Column | str],
    *,
    forward: bool = True,
    width: int = CHUNK_WIDTH,
    passes: Column | None = None,
) -> DataFrame:
    """Add each value of the next (``forward``) or previous row of the group."""
    keys = list(keys)
    df, passes, keep_chunk = _ready(df, keys, order, width, passes)
    w = Window.partitionBy(*keys, CHUNK).orderBy(order)
    edge = Window.partitionBy(*keys).orderBy(CHUNK)
    step = F.lead if forward else F.lag
    out = df.withColumns({n: step(col(e)).over(w) for n, e in values.items()}).withColumn(
        "_inner", step(F.lit(True)).over(w)
    )
    pick = F.min_by if forward else F.max_by
    ends = df.where(passes).groupBy(*keys, CHUNK).agg(
        *[pick(col(e), F.col(order)).alias(f"_t_{n}") for n, e in values.items()]
    )
    carry = ends.select(
        *keys, CHUNK, *[step(f"_t_{n}").over(edge).alias(f"_c_{n}") for n in values]
    )
    joined = out.join(carry, reduce(and_, [out[k] == carry[k] for k in (*keys, CHUNK)]), "left")
    pickup = {n: F.when(F.col("_inner"), F.col(n)).otherwise(F.col(f"_c_{n}")) for n in values}
    dropped = ("_inner",) if keep_chunk else ("_inner", CHUNK)
    return joined.select(*[pickup.get(c, out[c]).alias(c) for c in out.columns if c not in dropped])


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows of each group under a total order.

    The rank limit is applied before the shuffle as well, so a hot group sends
    at most ``n`` rows per input task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def best_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: str, out: str):
    """One value per group: that of the smallest order tuple (an aggregation, not a window)."""
    return df.groupBy(*keys).agg(F.min_by(col(value), F.struct(*order)).alias(out))


def first_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One whole row per key: the first in ``order``, which must be total for the result to be one.

    An aggregation: each task sends on one row per key, however many a key has. Null keys are one key.
    """
    rest = [c for c in df.columns if c not in keys]
    ranks = F.struct(*[col(o).alias(f"o{i}") for i, o in enumerate(order)])
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), ranks).alias("_row"))
    return first.select(*[F.col(c) if c in keys else F.col("_row").getField(c).alias(c) for c in df.columns])


# --- value-ordered prefix sums -------------------------------------------------


def range_boundaries(df: DataFrame, value: str, buckets: int) -> list[float]:
    """Literal bucket boundaries that split the rows of ``df`` about evenly."""
    if buckets < 2:
        return []
    probs = [i / buckets for i in range(1, buckets)]
    found = df.select(F.col(value).cast("double").alias(value)).approxQuantile(
        value, probs, 1.0 / (4 * buckets)
    )
    return sorted(set(found))


def with_bucket(df: DataFrame, value: str, boundaries: Sequence[float], out: str = "_bucket"):
    splits = [-math.inf, *boundaries, math.inf]
    if len(splits) == 2:
        return df.withColumn(out, F.lit(0))
    tmp = "_bucket_value"
    done = Bucketizer(splits=splits, inputCol=tmp, outputCol="_bucket_raw", handleInvalid="keep").transform(
        df.withColumn(tmp, F.col(value).cast("double"))
    )
    return done.withColumn(out, F.col("_bucket_raw").cast("int")).drop(tmp, "_bucket_raw")


def bucket_count(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def value_prefix(
    df: DataFrame,
    value: str,
    sums: Mapping[str, Column | str],
    *,
    by: Sequence[str] = (),
    ties: Sequence[Column | str] = (),
    descending: bool = False,
    buckets: int | None = None,
) -> DataFrame:
    """Exclusive running sums ``<name>_before`` and group totals ``<name>_total``.

    Rows are ordered by ``value`` (then ``ties``) within ``by``. Range buckets
    have literal boundaries, so every evaluation of the plan agrees on them;
    each task sorts one bucket, and the stitching table has one row per bucket
    and group. Pre-aggregate equal values first, so that no bucket can be hot.
    """
    by = list(by)
    # Needed for the boundaries, the bucket totals and the rows: computed once.
    df = cut_lineage(df, "ordered")
    bounds = range_boundaries(df, value, buckets or bucket_count(df))
    b = with_bucket(df, value, bounds)
    names = list(sums)
    b = b.withColumns({f"_v_{n}": col(e) for n, e in sums.items()})
    turn = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    totals = b.groupBy(*by, "_bucket").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in names])
    scope = by or [F.lit(0)]
    before = (
        Window.partitionBy(*scope)
        .orderBy(turn("_bucket"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    whole = Window.partitionBy(*scope)
    offsets = totals.select(
        *by,
        "_bucket",
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in names],
        *[F.sum(f"_t_{n}").over(whole).alias(f"{n}_total") for n in names],
    )
    inside = (
        Window.partitionBy(*by, "_bucket")
        .orderBy(turn(value), *ties)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = b.withColumns({f"_l_{n}": F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) for n in names})
    joined = local.join(offsets, _same(local, offsets, [*by, "_bucket"]), "inner")
    return joined.select(
        *[local[c] for c in df.columns],
        local["_bucket"],
        *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(f"{n}_before") for n in names],
        *[F.col(f"{n}_total") for n in names],
    )


def row_index(df: DataFrame, order: str, out: str = "row_index", ties=()) -> DataFrame:
    """0-based global position under (order, ties)."""
    keep = df.columns
    p = value_prefix(df, order, {"_n": F.lit(1)}, ties=ties)
    return p.select(*keep, F.col("_n_before").cast("long").alias(out))


def exact_percentiles(
    df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Exact linearly interpolated percentiles, one row per group and probability.

    NULL and NaN are left out. Works on distinct values with their counts, so no
    group is ever gathered in one place. Output: ``by, q, value``.
    """
    by = list(by)
    x = F.col(value).cast("double")
    counts = (
        df.where(x.isNotNull() & ~F.isnan(x))
        .groupBy(*by, x.alias("_x"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    p = value_prefix(counts, "_x", {"n": F.col("_c")}, by=by)
    qs = F.array(*[F.lit(float(q)) for q in probs])
    ranked = p.select(*by, "_x", "_c", "n_before", "n_total", F.explode(qs).alias("q"))
    pos = F.col("q") * (F.col("n_total") - 1)
    lo, hi = F.floor(pos), F.ceil(pos)
    holds = lambda r: (F.col("n_before") <= r) & (r < F.col("n_before") + F.col("_c"))
    picked = ranked.where(holds(lo) | holds(hi)).groupBy(*by, "q").agg(
        F.max(F.when(holds(lo), F.col("_x"))).alias("_lo"),
        F.max(F.when(holds(hi), F.col("_x"))).alias("_hi"),
        F.max(pos - lo).alias("_f"),
    )
    return picked.select(
        *by, "q", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")).alias("value")
    )


def average_rank(df: DataFrame, value: str, weight: str | None = None) -> DataFrame:
    """Distinct values with their average 1-based rank (``value, rank``)."""
    w = F.sum(weight) if weight else F.count(F.lit(1))
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(w.alias("_c"))
    p = value_prefix(counts, value, {"n": F.col("_c")})
    return p.select(value, (F.col("n_before") + (F.col("_c") + 1) / F.lit(2.0)).alias("rank"))
