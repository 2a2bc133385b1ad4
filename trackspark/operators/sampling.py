"""Exact-count sampling with replacement, its diagnostics and training tables.

Draws are keyed by (positive row, repetition): hashing that key with the seed
gives a uniform number, so the sample is reproducible under any partitioning and
is built without knowing a count beforehand.
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import beside, col, count_if, finite
from ..session import cut_lineage
from .ordered import bucket_count, range_boundaries, row_index, value_prefix, with_bucket

#: Weights count in such parts; sums of them are exact, up to 2^63 in all.
UNITS, EXACT = 1 << 20, "decimal(30,0)"
CHI2_FLOOR = 1e-3
_SCALE = float(2**52)


def uniform_hash(seed: int, *key: Column | str) -> Column:
    """Uniform number in [0, 1): the leading 52 bits of the MD5 of ``seed|key|...``, which any engine can repeat."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(k).cast("string") for k in key]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(_SCALE)


def _draws(pos: DataFrame, row_id: str, per_pos: int, seed: int) -> DataFrame:
    reps = pos.select(F.col(row_id).alias("_pos"), F.explode(F.sequence(F.lit(1), F.lit(per_pos))).alias("_rep"))
    return reps.select("_pos", "_rep", uniform_hash(seed, "_pos", "_rep").alias("_u"))


def uniform_subsample(df: DataFrame, label: str, row_id: str, per_pos: int, seed: int = 0) -> DataFrame:
    """All positives plus exactly ``per_pos`` uniform draws of negatives per positive.

    A negative drawn several times appears several times; without negatives only
    the positives are returned.
    """
    pos, neg = df.where(F.col(label) == 1), df.where(F.col(label) == 0)
    indexed = row_index(neg, row_id, "_index")
    size = neg.count()
    if size == 0:
        return pos
    picked = (
        _draws(pos, row_id, per_pos, seed)
        .select(F.least(F.floor(F.col("_u") * size), F.lit(size - 1)).cast("long").alias("_index"))
        .groupBy("_index")
        .agg(F.count(F.lit(1)).alias("_copies"))
    )
    return pos.unionByName(_repeat(indexed.join(picked, ["_index"], "inner").drop("_index"), df.columns))


def _repeat(df: DataFrame, columns) -> DataFrame:
    return df.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*columns)


def hard_weight(chi2: str) -> Column:
    """1/max(chi2, floor); 0 where chi2 is not finite."""
    return F.when(finite(chi2), F.lit(1.0) / F.greatest(F.col(chi2), F.lit(CHI2_FLOOR))).otherwise(F.lit(0.0))


def weighted_subsample(
    df: DataFrame, label: str, row_id: str, weight: Column, per_pos: int, seed: int = 0
) -> DataFrame:
    """As :func:`uniform_subsample`, negatives drawn in proportion to ``weight``.

    Each negative owns an interval of the cumulative weight, in units of 1/``UNITS`` (one at least), so that sums and
    borders are exact integers in any order of adding. A draw belongs to the
    interval that holds it. Range buckets of the cumulative weight (even in rows)
    are cut again into equal slices of weight (even in draws), so neither a heavy
    row nor a crowd of light ones can fill one task.
    """
    units = F.greatest(F.floor(F.col("_wd") * F.lit(float(UNITS))), F.lit(1)).cast(EXACT)
    pos, neg = df.where(F.col(label) == 1), df.where(F.col(label) == 0).withColumn("_wd", weight)
    live = neg.where(F.col("_wd") > 0).withColumn("_w", units).drop("_wd")
    total = live.agg(F.sum("_w").alias("w")).first().w
    if not total:
        return uniform_subsample(df, label, row_id, per_pos, seed)
    total = int(total)
    slices = 1 << (16 * bucket_count(df)).bit_length()
    width = -(-total // slices)
    # The running count is a unique row number even where row ids collide; written once,
    # because rows of equal id may be numbered differently by a second evaluation.
    spans = value_prefix(live, row_id, {"w": "_w", "i": F.lit(1)}).withColumnRenamed("i_before", "_index")
    spans = cut_lineage(spans.drop("_bucket"), "spans")
    placed = spans.select("_index", F.col("w_before").cast(EXACT).alias("_lo"), (F.col("w_before") + F.col("_w") - 1).cast(EXACT).alias("_hi"))
    cuts = sorted({Decimal(math.ceil(b)) for b in range_boundaries(placed, "_lo", bucket_count(df))})
    borders = F.array(*[F.lit(c).cast(EXACT) for c in cuts]).cast(f"array<{EXACT}>")

    def with_cells(d: DataFrame, at: str, bucket: str) -> DataFrame:
        """Number of borders at or below a place: the double's guess, corrected by the exact border on either side."""
        guess = with_bucket(d, at, [float(c) for c in cuts], bucket)
        under = F.col(at) < F.element_at(borders, F.col(bucket))
        over = F.col(at) >= F.element_at(borders, F.col(bucket) + 1)
        right = F.when((F.col(bucket) > 0) & under, F.col(bucket) - 1).when((F.col(bucket) < len(cuts)) & over, F.col(bucket) + 1)
        return guess.withColumn(bucket, F.coalesce(right, F.col(bucket)))

    ends = with_cells(with_cells(placed, "_lo", "_b0"), "_hi", "_b1")
    # Whole division: a decimal quotient would be rounded, possibly up to the next border.
    cell = lambda c: F.expr(f"{c} DIV CAST({width} AS DECIMAL(20,0))")
    # One entry per bucket or slice the interval starts or passes through.
    inner = F.when(F.col("_b1") > F.col("_b0"), F.transform(F.sequence(F.col("_b0") + 1, F.col("_b1")), lambda i: F.element_at(borders, i)))
    slice_cuts = F.transform(F.sequence(cell("_lo"), cell("_hi")), lambda k: (k * F.lit(Decimal(width))).cast(EXACT))
    starts = ends.select(
        F.col("_index").alias("_owner"),
        "_lo",
        F.explode(F.array_union(slice_cuts, F.coalesce(inner, F.array().cast(f"array<{EXACT}>")))).alias("_cut"),
    ).select("_owner", F.greatest("_lo", "_cut").alias("_at"))
    # A draw is a whole number below 2^52; its place is the same share of the total.
    place = F.expr(f"(CAST(_u * {2.0**52!r}D AS DECIMAL(16,0)) * CAST({total} AS DECIMAL(20,0))) DIV CAST({2**52} AS DECIMAL(16,0))").cast(EXACT)
    draws = _draws(pos, row_id, per_pos, seed).select(F.lit(None).cast("long").alias("_owner"), place.alias("_at"))
    events = starts.select(F.col("_owner").cast("long").alias("_owner"), "_at").withColumn("_draw", F.lit(0))
    keyed = with_cells(events.unionByName(draws.withColumn("_draw", F.lit(1))), "_at", "_b").withColumn("_s", cell("_at"))
    w = Window.partitionBy("_b", "_s").orderBy("_at", "_draw", "_owner").rowsBetween(Window.unboundedPreceding, 0)
    picked = (
        keyed.withColumn("_hit", F.last("_owner", ignorenulls=True).over(w))
        .where(F.col("_draw") == 1)
        .groupBy(F.col("_hit").alias("_index"))
        .agg(F.count(F.lit(1)).alias("_copies"))
    )
    return pos.unionByName(_repeat(spans.join(picked, ["_index"], "inner"), df.columns))


def class_counts(before: DataFrame, after: DataFrame, label: str) -> DataFrame:
    """Class counts before and after sampling with the prior logit shift (one row)."""

    def counts(df: DataFrame, suffix: str) -> DataFrame:
        y = F.col(label)
        return df.agg(count_if(y == 1).alias(f"n_pos_{suffix}"), count_if(y == 0).alias(f"n_neg_{suffix}"))

    j = beside(counts(before, "orig"), counts(after, "new"))
    return j.withColumn("prior_logit_shift", prior_shift("n_pos_orig", "n_neg_orig", "n_pos_new", "n_neg_new"))


def prior_shift(p0: str, n0: str, p1: str, n1: str) -> Column:
    """log(p1/n1) − log(p0/n0); NULL unless all four counts are positive."""
    ok = (F.col(p0) > 0) & (F.col(n0) > 0) & (F.col(p1) > 0) & (F.col(n1) > 0)
    return F.when(ok, F.log(F.col(p1) / F.col(n1)) - F.log(F.col(p0) / F.col(n0)))


def draw_diagnostics(df: DataFrame, weight: Column, n_take: int, top: int = 1000) -> DataFrame:
    """Expected coverage of ``n_take`` weighted draws with replacement (one row)."""
    w = df.select(weight.cast("double").alias("w")).where(finite("w") & (F.col("w") > 0))
    t = w.agg(
        F.count(F.lit(1)).alias("n_pool"),
        F.sum("w").alias("sum_w"),
        F.sum(F.col("w") * F.col("w")).alias("sum_w2"),
        F.max("w").alias("max_w"),
    )
    total = t.first()
    heavy = w.orderBy(F.col("w").desc()).limit(top).agg(F.sum("w").alias("top_w"))
    p = F.col("w") / F.lit(total.sum_w or 1.0)
    # -expm1(n log1p(-p)) is written for p < 1; a single item is always reached.
    reach = F.when(p < 1, -F.expm1(F.lit(float(n_take)) * F.log1p(-p))).otherwise(F.lit(1.0))
    distinct = w.agg(F.sum(reach).alias("expected_distinct"))
    j = beside(beside(t, heavy), distinct)
    return j.select(
        F.lit(int(n_take)).cast("long").alias("n_take"),
        "n_pool",
        "expected_distinct",
        (F.col("expected_distinct") / n_take).alias("coverage"),
        (F.col("max_w") / F.col("sum_w") * n_take).alias("max_expected_copies"),
        (F.col("max_w") / F.col("sum_w")).alias("top1_mass"),
        (F.col("top_w") / F.col("sum_w")).alias("top1000_mass"),
        (F.col("sum_w") * F.col("sum_w") / F.col("sum_w2")).alias("kish_ess"),
    )


def oversample(df: DataFrame, marginal: Column, extra: int) -> DataFrame:
    """Repeat marginal rows ``1 + extra`` times."""
    n = F.when(marginal, F.lit(1 + extra)).otherwise(F.lit(1))
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), n)))


def drop_ambiguous(df: DataFrame, flag: str = "label_ambiguous") -> DataFrame:
    return df.where(~F.coalesce(F.col(flag), F.lit(False)))


def refuse_partial(meta: DataFrame) -> None:
    """Raise when a feature table covers only part of its split."""
    bad = meta.where(F.coalesce(F.col("is_partial"), F.lit(False)))
    if not bad.isEmpty():
        raise ValueError("feature table is marked as partial; refusing to train on it")


def soft_label_rows(df: DataFrame, target: str) -> DataFrame:
    """Two weighted rows per soft target: label 1 with weight v, label 0 with 1 − v."""
    pair = F.array(
        F.struct(F.lit(1.0).alias("label"), F.col(target).alias("weight")),
        F.struct(F.lit(0.0).alias("label"), (F.lit(1.0) - F.col(target)).alias("weight")),
    )
    out = df.withColumn("_p", F.explode(pair))
    return out.select(*df.columns, "_p.label", "_p.weight").where(F.col("weight") > 0)
