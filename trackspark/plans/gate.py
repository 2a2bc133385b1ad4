"""Candidate table to a scored, calibrated and audited gate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.features import GATE_FEATURES, collect_stats, gate_features, norm_stats, standardise
from ..functions.geometry import chi2_probability, pseudorapidity
from ..functions.strata import eta_stratum, label_columns, occupancy_stratum
from ..operators import calibration, platt, sampling, scoring
from ..session import cut_lineage

CARRY = ("event_id", "row_id", "label", "raw_chi2", "occupancy", "theta")


def training_rows(rows: DataFrame) -> DataFrame:
    """Trainable candidate rows with label, key and the gate features."""
    lab = label_columns()
    key = F.xxhash64("event_id", "seed_id", "branch_id", "step_k", "cand_hit_id")
    d = rows.where(lab["gate_row_mask"]).withColumns(
        {
            "row_id": key,
            "label": lab["label_same_particle"],
            "raw_chi2": F.col("chi2_inc"),
            "occupancy": F.col("n_window"),
            "theta": F.col("state_theta"),
        }
    )
    return gate_features(d, CARRY)


@dataclass
class GateFit:
    features: list[str]
    stats: dict[str, tuple[float, float]]
    weights: list[float]
    bias: float
    platt2: tuple[float, ...]
    platt4: tuple[float, ...]


def fit_gate(
    train: DataFrame, valid: DataFrame, cal: DataFrame, features=GATE_FEATURES, per_pos: int | None = None, seed: int = 0
) -> GateFit:
    """Normalise on the training rows, sample, fit, then calibrate on the calibration rows.

    The inputs should be stored feature tables: training reads them several times.
    """
    norms = collect_stats(norm_stats(train, features))
    picked = train if per_pos is None else sampling.uniform_subsample(train, "label", "row_id", per_pos, seed)
    picked = cut_lineage(picked.select("label", *features), "sample")
    w, b, _ = scoring.fit_logit(standardise(picked, norms), standardise(valid, norms), list(features))
    scored = standardise(cal, norms).withColumn("logit", scoring.linear_logit(features, w, b))
    p2 = platt.fit_platt(scored, "logit", "label").params
    p4 = platt.fit_platt_occupancy(scored, "logit", "label", "occupancy").params
    return GateFit(list(features), norms, w, b, p2, p4)


def apply_gate(rows: DataFrame, fit: GateFit) -> DataFrame:
    """Rows with the logit and the raw and calibrated probabilities beside the chi2 one."""
    d = standardise(rows, fit.stats).withColumn("logit", scoring.linear_logit(fit.features, fit.weights, fit.bias))
    return d.withColumns(
        {
            "chi2": chi2_probability("raw_chi2"),
            "raw": stats.sigmoid("logit"),
            "platt2": stats.platt("logit", *fit.platt2),
            "platt4": stats.platt_occupancy("logit", "occupancy", fit.platt4),
        }
    )


def audit_gate(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stratified audit of the four estimators and the verdicts."""
    strata = {
        "all": F.lit("all"),
        "eta": eta_stratum(pseudorapidity("theta")),
        "occupancy": occupancy_stratum("occupancy"),
    }
    audit = calibration.stratified_audit(scored, ["chi2", "raw", "platt2", "platt4"], strata, "label")
    return audit, calibration.audit_verdicts(audit, "platt2", "chi2", "platt4")
