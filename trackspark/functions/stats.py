"""Scalar statistics as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import clip, col

# Fixed value: two-sided 95 % normal quantile.
Z95 = 1.959963984540054


def wilson(k, n, z: float = 1.0) -> tuple[Column, Column]:
    """Wilson score interval clipped to [0, 1]; NULL where n = 0."""
    n = col(n).cast("double")
    p = col(k).cast("double") / n
    z2 = z * z
    denom = F.lit(1.0) + F.lit(z2) / n
    centre = (p + F.lit(z2) / (n * 2)) / denom
    half = F.lit(z) * F.sqrt(p * (F.lit(1.0) - p) / n + F.lit(z2) / (n * n * 4)) / denom
    lo, hi = clip(centre - half, 0.0, 1.0), clip(centre + half, 0.0, 1.0)
    return F.when(n > 0, lo), F.when(n > 0, hi)


def wilson95(k, n) -> tuple[Column, Column]:
    """95 % Wilson interval that always contains k/n; (0, 1) where n = 0."""
    lo, hi = wilson(k, n, Z95)
    p = F.when(col(n) > 0, col(k).cast("double") / col(n).cast("double"))
    return (
        F.when(col(n) > 0, F.least(lo, p)).otherwise(F.lit(0.0)),
        F.when(col(n) > 0, F.greatest(hi, p)).otherwise(F.lit(1.0)),
    )


def sigmoid(z) -> Column:
    """Logistic function that does not overflow for large |z|."""
    e = F.exp(-F.abs(col(z)))
    return F.when(col(z) >= 0, F.lit(1.0) / (F.lit(1.0) + e)).otherwise(e / (F.lit(1.0) + e))


def log_odds(p, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1.0 - eps)
    return F.log(q / (F.lit(1.0) - q))


def platt(logit, a: float, b: float) -> Column:
    return sigmoid(F.lit(a) * col(logit) + F.lit(b))


def log_occupancy(n_window) -> Column:
    return F.log(F.greatest(col(n_window).cast("double"), F.lit(1.0)))


def platt_occupancy(logit, n_window, params: tuple[float, float, float, float]) -> Column:
    """Platt map whose slope and offset are linear in log occupancy."""
    a0, a1, b0, b1 = params
    x = log_occupancy(n_window)
    return sigmoid((F.lit(a0) + F.lit(a1) * x) * col(logit) + (F.lit(b0) + F.lit(b1) * x))


def bce_with_logits(logit, target) -> Column:
    """Cross entropy of one row from its logit, in the stable form."""
    z = col(logit)
    return F.greatest(z, F.lit(0.0)) - z * col(target) + F.log1p(F.exp(-F.abs(z)))


def bce(prob, target, eps: float = 1e-7) -> Column:
    p = clip(prob, eps, 1.0 - eps)
    y = col(target)
    return -(y * F.log(p) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - p))


def logit_edges(n_bins: int, p_min: float = 1e-5, p_max: float = 1.0 - 1e-5) -> list[float]:
    """n+1 probability edges, equally spaced in log-odds."""
    lo, hi = math.log(p_min / (1 - p_min)), math.log(p_max / (1 - p_max))
    step = (hi - lo) / n_bins
    return [1.0 / (1.0 + math.exp(-(lo + i * step))) for i in range(n_bins)] + [
        1.0 / (1.0 + math.exp(-hi))
    ]
