"""Candidate table to training rows of the value model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import true
from ..operators import failure, targets
from ..operators.truth import particle_totals


def value_rows(
    rows: DataFrame,
    simhits: DataFrame,
    rollout: DataFrame | None = None,
    window_nsigma: float = 0.0,
    pure_only: bool = False,
) -> DataFrame:
    """Features and target per state; the logged target, or a rollout target at its window."""
    defined = rows.where(~true("majority_undefined"))
    if pure_only:
        pure = failure.seed_purity(defined).where(F.col("seed_purity") == "pure")
        defined = defined.join(pure, list(targets.BRANCH), "left_semi")
    feats = targets.value_features(defined)
    key = list(targets.STATE)
    if rollout is not None:
        kept, _ = targets.attach_targets(feats, rollout, window_nsigma)
        return kept.withColumnRenamed("vstar_rollout", "target")
    logged = targets.valid_targets(targets.logged_targets(targets.step_table(defined), particle_totals(simhits)))
    return feats.join(logged.select(*key, F.col("vstar_t2").alias("target")), key, "inner")
