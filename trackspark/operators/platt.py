"""Platt scaling fitted by Newton steps, each step one aggregation over the scores."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import bce_with_logits, log_occupancy, sigmoid
from ..session import cut_lineage


@dataclass
class LogisticFit:
    params: tuple[float, ...]
    trace: list[float] = field(default_factory=list)  # mean NLL: start, each step, result


def fit_logistic(
    df: DataFrame,
    design: list[Column],
    label: str,
    start: list[float],
    weight: Column | None = None,
    max_steps: int = 50,
    tolerance: float = 1e-10,
) -> LogisticFit:
    """Damped Newton fit of a logistic model with at most a handful of parameters.

    Gradient and Hessian (p + p² sums) are computed on the executors; only those
    sums reach the driver. A single-class sample is refused.
    """
    k = len(design)
    w = F.lit(1.0) if weight is None else weight
    base = df.select(
        *[d.cast("double").alias(f"x{i}") for i, d in enumerate(design)],
        F.col(label).cast("double").alias("y"),
        w.cast("double").alias("w"),
    )
    # Every step reads these few columns again, so they are stored once.
    base = cut_lineage(base, "logistic")
    seen = base.agg(F.min("y").alias("lo"), F.max("y").alias("hi"), F.sum("w").alias("w")).first()
    if seen.w is None or seen.lo > 0.5 or seen.hi <= 0.5:
        raise ValueError("calibration rows must contain both classes")

    def evaluate(theta: np.ndarray):
        z = sum((F.col(f"x{i}") * F.lit(float(theta[i])) for i in range(1, k)), F.col("x0") * F.lit(float(theta[0])))
        p = sigmoid(z)
        aggs = [F.sum(F.col("w") * bce_with_logits(z, "y"))]
        aggs += [F.sum(F.col("w") * (p - F.col("y")) * F.col(f"x{i}")) for i in range(k)]
        aggs += [
            F.sum(F.col("w") * p * (F.lit(1.0) - p) * F.col(f"x{i}") * F.col(f"x{j}"))
            for i in range(k)
            for j in range(i, k)
        ]
        row = [float(v) for v in base.agg(*[a.alias(f"a{n}") for n, a in enumerate(aggs)]).first()]
        hess = np.zeros((k, k))
        it = iter(row[1 + k :])
        for i in range(k):
            for j in range(i, k):
                hess[i, j] = hess[j, i] = next(it)
        return row[0] / seen.w, np.array(row[1 : 1 + k]) / seen.w, hess / seen.w

    theta = np.array(start, dtype=float)
    nll, grad, hess = evaluate(theta)
    trace = [nll]
    for _ in range(max_steps):
        step = np.linalg.lstsq(hess + 1e-12 * np.eye(k), grad, rcond=None)[0]
        scale = 1.0
        while True:
            trial = theta - scale * step
            new = evaluate(trial)
            if new[0] <= nll + 1e-15 or scale < 1e-6:
                break
            scale /= 2
        moved = nll - new[0]
        theta, (nll, grad, hess) = trial, new
        trace.append(nll)
        if float(np.max(np.abs(grad))) < tolerance or abs(moved) < 1e-15:
            break
    trace.append(nll)
    return LogisticFit(tuple(float(t) for t in theta), trace)


def fit_platt(df: DataFrame, logit: str, label: str) -> LogisticFit:
    """Slope and offset on the logit."""
    return fit_logistic(df, [F.col(logit), F.lit(1.0)], label, [1.0, 0.0])


def fit_platt_occupancy(df: DataFrame, logit: str, label: str, n_window: str) -> LogisticFit:
    """(a0, a1, b0, b1): slope and offset linear in log occupancy."""
    x, z = log_occupancy(n_window), F.col(logit)
    return fit_logistic(df, [z, z * x, F.lit(1.0), x], label, [1.0, 0.0, 0.0, 0.0])
