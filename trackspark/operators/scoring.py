"""Model scoring, gate selection, branch stopping and the re-aimed fit."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import count_if, true
from .ordered import first_n

STATE = ("event_id", "seed_id", "branch_id", "step_k")


@dataclass(frozen=True)
class Mlp:
    """A dense network: standardisation, hidden SiLU layers, one raw output."""

    features: tuple[str, ...]
    mu: tuple[float, ...]
    sigma: tuple[float, ...]
    weights: tuple[np.ndarray, ...]  # one (out, in) matrix per layer
    biases: tuple[np.ndarray, ...]

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = (x - np.asarray(self.mu)) / np.asarray(self.sigma)
        for i, (w, b) in enumerate(zip(self.weights, self.biases)):
            h = h @ w.T + b
            if i < len(self.weights) - 1:
                h = h / (1.0 + np.exp(-h))
        return h[:, 0]


def mlp_from_table(layers: DataFrame, stats: DataFrame) -> Mlp:
    """Model from its parameter tables (``layer, row, col, value`` with col −1 the bias; norm stats).

    The tables hold one number per model weight, so they are small by definition.
    """
    s = sorted(stats.collect(), key=lambda r: r.position)
    cells = layers.collect()
    weights, biases = [], []
    for layer in sorted({c.layer for c in cells}):
        part = [c for c in cells if c.layer == layer]
        rows, cols = max(c.row for c in part) + 1, max(c.col for c in part) + 1
        w, b = np.zeros((rows, cols)), np.zeros(rows)
        for c in part:
            if c.col < 0:
                b[c.row] = c.value
            else:
                w[c.row, c.col] = c.value
        weights.append(w)
        biases.append(b)
    return Mlp(
        tuple(r.feature for r in s),
        tuple(r.mu for r in s),
        tuple(r.sigma for r in s),
        tuple(weights),
        tuple(biases),
    )


def score(df: DataFrame, model: Mlp, out: str = "logit") -> DataFrame:
    """Add the raw model output; batches go through one matrix product per layer."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def forward(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        m = shared.value
        for cols in batches:
            x = np.column_stack([c.to_numpy(dtype=np.float64) for c in cols])
            yield pd.Series(m.logits(x))

    return df.withColumn(out, forward(*[F.col(f).cast("double") for f in model.features]))


def linear_logit(features: Sequence[str], weights: Sequence[float], bias: float) -> Column:
    """Logit of a linear model as a plain expression."""
    z = F.lit(float(bias))
    for f, w in zip(features, weights):
        z = z + F.lit(float(w)) * F.col(f)
    return z


# --- selection ---------------------------------------------------------------------------


def select_candidates(
    rows: DataFrame, score_col: str, threshold: float, keep: int, in_window: Column | None = None, keys=STATE
) -> DataFrame:
    """At most ``keep`` candidates per state with score ≥ threshold, best score first."""
    window = F.lit(True) if in_window is None else in_window
    ok = rows.where((F.col("cand_hit_id") != -1) & window & (F.col(score_col) >= threshold))
    return first_n(ok, keys, [F.col(score_col).desc(), F.col("cand_hit_id")], keep)


def selection_outcome(
    rows: DataFrame, score_col: str, threshold: float, in_window: Column | None = None, keys=STATE
) -> DataFrame:
    """Per state the counts and, for a hole, why nothing was kept."""
    window = F.lit(True) if in_window is None else in_window
    hit = F.col("cand_hit_id") != -1
    inside = hit & F.coalesce(window, F.lit(False))
    passed = inside & (F.col(score_col) >= threshold)
    g = rows.groupBy(*keys).agg(
        count_if(hit).alias("n_candidates"),
        count_if(inside).alias("n_in_window"),
        count_if(passed).alias("n_passed"),
        F.sum(F.when(passed, F.col("chi2_inc"))).alias("sum_chi2_accepted"),
        F.sum(F.when(inside & ~passed, F.col("chi2_inc"))).alias("sum_chi2_rejected"),
        F.max(F.when(passed, F.col("chi2_inc"))).alias("max_chi2_accepted"),
    )
    cause = (
        F.when(F.col("n_candidates") == 0, F.lit("no_measurements"))
        .when(F.col("n_in_window") == 0, F.lit("window_failure"))
        .when(F.col("n_passed") == 0, F.lit("gate_failure"))
    )
    return g.withColumn("hole_cause", cause)


def selection_counters(outcome: DataFrame) -> DataFrame:
    """Accepted / rejected counts, hole causes and chi2 sums per event."""
    causes = ("no_measurements", "window_failure", "gate_failure")
    return outcome.groupBy("event_id").agg(
        F.sum("n_passed").alias("n_accepted"),
        F.sum(F.col("n_in_window") - F.col("n_passed")).alias("n_rejected"),
        F.sum(F.col("n_candidates") - F.col("n_in_window")).alias("n_prefiltered"),
        *[count_if(F.col("hole_cause") == c).alias(f"n_hole_{c}") for c in causes],
        F.coalesce(F.sum("sum_chi2_accepted"), F.lit(0.0)).alias("sum_chi2_accepted"),
        F.coalesce(F.sum("sum_chi2_rejected"), F.lit(0.0)).alias("sum_chi2_rejected"),
        F.max("max_chi2_accepted").alias("max_chi2_accepted"),
    )


def stop_decision(
    states: DataFrame,
    prob: str,
    threshold: float,
    min_before: int = 3,
    min_keep: int = 6,
    keys=("event_id", "seed_id", "branch_id"),
) -> DataFrame:
    """First step at which each branch is stopped and whether it is kept.

    Below ``min_before`` hits a branch always continues.
    """
    fails = (F.col("n_hits") >= min_before) & (F.col(prob) < threshold)
    g = states.groupBy(*keys).agg(
        F.min(F.when(fails, F.struct("step_k", "n_hits"))).alias("_s"), F.count(F.lit(1)).alias("n_states")
    )
    decision = (
        F.when(F.col("_s").isNull(), F.lit("continue"))
        .when(F.col("_s.n_hits") >= min_keep, F.lit("stop_keep"))
        .otherwise(F.lit("stop_drop"))
    )
    return g.select(*keys, "n_states", F.col("_s.step_k").alias("stop_step"), decision.alias("decision"))


# --- fit -----------------------------------------------------------------------------------


def fit_logit(
    train: DataFrame,
    valid: DataFrame,
    features: Sequence[str],
    label: str = "label",
    weight: str | None = None,
    penalties: Sequence[float] = (0.0, 1e-4, 1e-2),
):
    """Logistic models over a small penalty grid; the one with the lowest validation loss.

    Returns (weights, bias, report) where report lists (penalty, validation loss).
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    from ..functions.stats import bce_with_logits

    assemble = VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="error")
    t = assemble.transform(train).select("_x", F.col(label).cast("double").alias("_y"), *([weight] if weight else []))
    best, report = None, []
    for penalty in penalties:
        lr = LogisticRegression(
            featuresCol="_x", labelCol="_y", regParam=penalty, standardization=False, maxIter=100, tol=1e-9
        )
        m = (lr.setWeightCol(weight) if weight else lr).fit(t)
        w, b = [float(v) for v in m.coefficients], float(m.intercept)
        loss = valid.agg(F.avg(bce_with_logits(linear_logit(features, w, b), F.col(label).cast("double")))).first()[0]
        report.append((penalty, loss))
        if best is None or loss < best[0]:
            best = (loss, w, b)
    return best[1], best[2], report


def logit_likelihood(df: DataFrame, features: Sequence[str], weights: Sequence[float], bias: float, label: str = "label", weight: str | None = None) -> DataFrame:
    """One row: summed weight, mean loss and mean gradient of a logistic model at the given parameters."""
    from ..functions.stats import bce_with_logits, sigmoid

    z = linear_logit(features, weights, bias)
    y, w = F.col(label).cast("double"), F.col(weight).cast("double") if weight else F.lit(1.0)
    mean = lambda e: F.sum(w * e) / F.sum(w)
    miss = sigmoid(z) - y
    return df.agg(
        F.sum(w).alias("weight"),
        mean(bce_with_logits(z, y)).alias("loss"),
        *[mean(miss * F.col(f)).alias(f"g_{f}") for f in features],
        mean(miss).alias("g_bias"),
    )


def gate_choice_quality(rows: DataFrame, accepted: str, by: str = "step_k", keys=STATE) -> DataFrame:
    """Best accepted chi2 against the best available one, summarised per step."""
    from .ordered import exact_percentiles

    s = rows.groupBy(*keys).agg(
        F.min("chi2_inc").alias("min_chi2"), F.min(F.when(true(accepted), F.col("chi2_inc"))).alias("acc_chi2")
    ).where(F.col("acc_chi2").isNotNull())
    s = s.withColumns(
        {
            "ratio": F.col("acc_chi2") / F.greatest("min_chi2", F.lit(1e-6)),
            "best": (F.abs(F.col("acc_chi2") - F.col("min_chi2")) < 0.01).cast("double"),
        }
    )
    med = exact_percentiles(s, "ratio", [0.5], by=[by]).select(by, F.col("value").alias("median_ratio"))
    g = s.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("ratio").alias("mean_ratio"),
        F.avg("best").alias("chose_best"),
        F.avg("acc_chi2").alias("mean_acc_chi2"),
        F.avg("min_chi2").alias("mean_min_chi2"),
    )
    return g.join(med, [by], "left")


def chi2_quantiles(rows: DataFrame, accepted: str, probs: Sequence[float], by: str = "step_k") -> DataFrame:
    """Chi2 percentiles per step over all and over accepted candidates."""
    from .ordered import exact_percentiles

    r = rows.where(F.col("chi2_inc").isNotNull())
    everyone = exact_percentiles(r, "chi2_inc", probs, by=[by]).withColumn("which", F.lit("all"))
    taken = exact_percentiles(r.where(true(accepted)), "chi2_inc", probs, by=[by]).withColumn(
        "which", F.lit("accepted")
    )
    return everyone.unionByName(taken)


def feature_drift(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    """Mean, deviation ratio, z-outlier shares and median z per feature against stored statistics."""
    from .ordered import exact_percentiles

    entry = [
        F.struct(
            F.lit(n).alias("feature"),
            F.col(n).cast("double").alias("x"),
            F.lit(float(m)).alias("mu"),
            F.lit(float(s)).alias("sigma"),
        )
        for n, (m, s) in stats.items()
    ]
    long = df.select(F.explode(F.array(*entry)).alias("e")).select("e.*")
    z = F.when(F.col("sigma") > 1e-12, (F.col("x") - F.col("mu")) / F.col("sigma"))
    long = long.withColumn("z", z)
    share = lambda k: F.avg((F.abs("z") > k).cast("double")).alias(f"frac_z_gt_{k}")
    g = long.groupBy("feature").agg(
        F.avg("x").alias("emp_mean"),
        F.stddev_pop("x").alias("emp_std"),
        F.max("sigma").alias("_s"),
        *[share(k) for k in (3, 5, 10)],
    )
    med = exact_percentiles(long, "z", [0.5], by=["feature"]).select("feature", F.col("value").alias("median_z"))
    ratio = F.when(F.col("_s") > 1e-12, F.col("emp_std") / F.col("_s"))
    out = g.withColumn("std_ratio", ratio).drop("_s")
    ok = F.coalesce((F.col("std_ratio") > 0.1) & (F.col("std_ratio") < 10), F.lit(False))
    return out.withColumn("matches", ok).join(med, ["feature"], "left")
