"""SQL fragments used by several oracles."""

from __future__ import annotations

import math

from ..functions.stats import Z95, logit_edges

PI = repr(math.pi)


def clip(x: str, lo: str, hi: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN greatest({lo}, least({hi}, {x})) END"


def eta(theta: str, eps: str = "1e-6") -> str:
    return f"(-ln(tan(greatest({eps}, least({PI}::DOUBLE - {eps}, {theta})) / 2e0)))"


def bucket(x: str, inner) -> str:
    """0-based half-open bin by interior edges."""
    whens = " ".join(f"WHEN {x} < {float(e)!r}::DOUBLE THEN {i}" for i, e in enumerate(inner))
    return f"CASE WHEN {x} IS NULL THEN NULL {whens} ELSE {len(inner)} END"


def wilson(k: str, n: str, z: float = 1.0) -> tuple[str, str]:
    z2 = repr(z * z)
    p = f"({k} * 1e0 / {n})"
    den = f"(1e0 + {z2} / {n})"
    mid = f"(({p} + {z2} / (2e0 * {n})) / {den})"
    half = f"({z!r} * sqrt({p} * (1e0 - {p}) / {n} + {z2} / (4e0 * {n} * {n})) / {den})"
    return (
        f"CASE WHEN {n} > 0 THEN greatest(0e0, least(1e0, {mid} - {half})) END",
        f"CASE WHEN {n} > 0 THEN greatest(0e0, least(1e0, {mid} + {half})) END",
    )


def wilson95(k: str, n: str) -> tuple[str, str]:
    lo, hi = wilson(k, n, Z95)
    return (
        f"CASE WHEN {n} > 0 THEN least({lo}, {k} * 1e0 / {n}) ELSE 0e0 END",
        f"CASE WHEN {n} > 0 THEN greatest({hi}, {k} * 1e0 / {n}) ELSE 1e0 END",
    )


EDGES30 = logit_edges(30)
MEMBER = "coalesce(list_contains(contrib_pids, branch_majority_pid), false)"
TRUE_HIT = f"({MEMBER} AND cand_hit_id >= 0)"
SENSOR = (
    "CASE WHEN volume_id IN (16, 17, 18) THEN 0 WHEN volume_id IN (23, 24, 25) THEN 1 "
    "WHEN volume_id IN (28, 29, 30) THEN 2 ELSE -1 END"
)
NEED = (
    "CASE WHEN is_1d THEN abs(residual_l0) / sqrt(S00) "
    "ELSE greatest(abs(residual_l0) / sqrt(S00), abs(residual_l1) / sqrt(S11)) END"
)
STATE = "event_id, seed_id, branch_id, step_k"
BRANCH = "event_id, seed_id, branch_id"
OCC_LABEL = (
    "CASE WHEN n_window < 1 THEN NULL WHEN n_window <= 1 THEN 'n=1 (isolated)' WHEN n_window <= 3 THEN 'n=2-3' "
    "WHEN n_window <= 6 THEN 'n=4-6' ELSE 'n=7+' END"
)
CHI2P = (
    "greatest(1e-6, least(1e0 - 1e-6, "
    "CASE WHEN chi2_inc IS NULL THEN 0e0 ELSE exp(-greatest(chi2_inc, 0e0) / 2e0) END))"
)
LOGODDS = f"ln({CHI2P} / (1e0 - {CHI2P}))"
