"""Small column helpers shared by all expression modules."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """True for a real number; NULL, NaN and infinities give false."""
    x = col(c).cast("double")
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(math.inf)), F.lit(False))


def finite_or_null(c: Column | str) -> Column:
    return F.when(finite(c), col(c))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every floating column (Spark sorts NaN above all numbers)."""
    floats = {"double", "float"}
    return df.select(
        *[
            F.when(~F.isnan(F.col(n)), F.col(n)).alias(n) if t in floats else F.col(n)
            for n, t in df.dtypes
        ]
    )


def true(c: Column | str) -> Column:
    """A predicate with NULL read as false."""
    return F.coalesce(col(c).cast("boolean"), F.lit(False))


def count_if(c: Column) -> Column:
    """Conditional count that is 0, not NULL, on empty input."""
    return F.count(F.when(c, F.lit(1)))


def ratio(num: Column | str, den: Column | str) -> Column:
    """num/den as double; NULL for a zero denominator."""
    return F.when(col(den) != 0, col(num).cast("double") / col(den).cast("double"))


def clip(c: Column | str, lo: float, hi: float) -> Column:
    """Clamp, keeping NULL."""
    return F.when(col(c).isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), col(c))))


def bin_index(c: Column | str, inner: Sequence[float]) -> Column:
    """Index of the half-open bin ``[edge, next)`` by the interior edges; ends open.

    A balanced comparison tree, so it stays in generated code; for long uniform
    grids use :func:`grid_index`.
    """
    x = col(c).cast("double")

    def node(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x >= F.lit(float(inner[mid])), node(mid + 1, hi)).otherwise(node(lo, mid))

    return F.when(x.isNotNull(), node(0, len(inner)))


def grid_index(c: Column | str, lo: float, hi: float, n: int) -> Column:
    """Bin of a uniform grid of ``n`` bins on ``[lo, hi]``, values clamped, last bin closed.

    The arithmetic guess is corrected against the edge ``lo + i*step`` so that a
    value on an edge lands in the upper bin.
    """
    step = (hi - lo) / n
    x = clip(col(c).cast("double"), lo, hi)
    guess = F.floor((x - F.lit(lo)) / F.lit(step)).cast("int")
    edge = lambda i: F.lit(lo) + i * F.lit(step)
    fixed = (
        F.when(x < edge(guess), guess - 1).when(x >= edge(guess + 1), guess + 1).otherwise(guess)
    )
    return F.when(x.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(n - 1), fixed)))


def beside(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Put the columns of a one-row table (an aggregate without groups) on every row."""
    return df.join(F.broadcast(one_row), F.lit(True))
