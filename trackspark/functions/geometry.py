"""Window, chi-square, kinematic and cluster expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import clip, col, finite, true

# Numeric floors and clips.
THETA_EPS = 1e-6
VARIANCE_FLOOR = 1e-30
PROBABILITY_CLIP = 1e-6


def half_width(variance: Column | str, n: float | Column) -> Column:
    """n·sqrt(variance), negative variances read as 0."""
    n = n if isinstance(n, Column) else F.lit(float(n))
    return n * F.sqrt(F.when(col(variance).isNotNull(), F.greatest(col(variance), F.lit(0.0))))


def in_box(r0, r1, s00, s11, is_1d, n) -> Column:
    """|r0| and, for two-dimensional hits, |r1| within n standard deviations."""
    leg0 = F.abs(col(r0)) <= half_width(s00, n)
    leg1 = true(is_1d) | F.coalesce(F.abs(col(r1)) <= half_width(s11, n), F.lit(False))
    return F.coalesce(leg0, F.lit(False)) & leg1


def in_radius(r0, r1, is_1d, radius: float) -> Column:
    r1 = F.when(true(is_1d), F.lit(0.0)).otherwise(col(r1))
    # hypot is slow, and never less than either leg.
    near = (F.abs(col(r0)) <= F.lit(radius)) & (F.abs(r1) <= F.lit(radius)) & (F.hypot(col(r0), r1) <= F.lit(radius))
    return F.coalesce(near, F.lit(False))


def in_ellipse(chi2, n) -> Column:
    """chi2 < n²; a non-positive n switches the test off."""
    n = n if isinstance(n, Column) else F.lit(float(n))
    return (n <= 0) | F.coalesce(col(chi2) < n * n, F.lit(False))


def chi2_increment(r0, r1, s00, s01, s11, is_1d) -> Column:
    """r'S⁻¹r; one-dimensional hits use r0²/S00, a degenerate S the diagonal sum."""
    r0, r1, s00, s11 = col(r0), col(r1), col(s00), col(s11)
    s01 = F.coalesce(col(s01), F.lit(0.0))
    one_d = F.when(s00 > 0, r0 * r0 / s00)
    det = s00 * s11 - s01 * s01
    full = (s11 * r0 * r0 - F.lit(2.0) * s01 * r0 * r1 + s00 * r1 * r1) / det
    diagonal = one_d + F.when(s11 > 0, r1 * r1 / s11)
    return F.when(true(is_1d), one_d).when(finite(det) & (det > 0), full).otherwise(diagonal)


def chi2_full_and_diagonal(r0, r1, s00, s01, s11) -> dict[str, Column]:
    """Full and diagonal chi-square with their ratio and difference."""
    floor = lambda s: F.when(col(s).isNotNull(), F.greatest(col(s), F.lit(VARIANCE_FLOOR)))
    diag = col(r0) * col(r0) / floor(s00) + col(r1) * col(r1) / floor(s11)
    det = col(s00) * col(s11) - col(s01) * col(s01)
    solved = chi2_increment(r0, r1, s00, s01, s11, F.lit(False))
    full = F.when(finite(det) & (det > 0), solved).otherwise(diag)
    return {
        "chi2_full": full,
        "chi2_diag": diag,
        "chi2_ratio": F.when(F.abs(diag) > 1e-12, full / diag),
        "chi2_delta": full - diag,
    }


def correlation(s00, s01, s11) -> Column:
    """rho = S01/sqrt(S00·S11), clipped to [-1, 1]; NULL for a degenerate S."""
    product = col(s00) * col(s11)
    return F.when((col(s00) > 0) & (col(s11) > 0), clip(col(s01) / F.sqrt(product), -1.0, 1.0))


def correlation_from_pulls(chi2, pull0, pull1) -> Column:
    """rho solving chi2·(1−rho²) = a² + b² − 2·rho·a·b.

    Of the roots inside [-1, 1] the one with the sign of a·b is preferred, the
    larger first; with none inside, the larger root is clipped. A negative
    discriminant counts as 0, and an already diagonal chi2 gives 0.
    """
    a, b, c = col(pull0), col(pull1), col(chi2)
    ab, diag = a * b, a * a + b * b
    root = F.sqrt(F.greatest(ab * ab - c * (diag - c), F.lit(0.0)))
    high, low = (ab + root) / c, (ab - root) / c
    inside = lambda r: (r >= -1.0) & (r <= 1.0)
    same_sign = lambda r: inside(r) & (ab != 0) & (r * ab >= 0)
    picked = (
        F.when(same_sign(high), high)
        .when(same_sign(low), low)
        .when(inside(high), high)
        .when(inside(low), low)
        .otherwise(clip(high, -1.0, 1.0))
    )
    known = finite(c) & finite(diag)
    return F.when(known & (F.abs(c - diag) < 1e-12), F.lit(0.0)).when(
        known & (F.abs(c) >= 1e-30), picked
    )


def pseudorapidity(theta, eps: float = THETA_EPS) -> Column:
    return -F.log(F.tan(clip(theta, eps, math.pi - eps) / F.lit(2.0)))


def cholesky_2x2(s00, s01, s11) -> dict[str, Column]:
    floor = F.lit(VARIANCE_FLOOR)
    l00 = F.sqrt(F.when(col(s00).isNotNull(), F.greatest(col(s00), floor)))
    l10 = col(s01) / l00
    s11 = F.when(col(s11).isNotNull(), F.greatest(col(s11), floor))
    schur = s11 - l10 * l10
    l11 = F.sqrt(F.when(schur.isNotNull(), F.greatest(schur, floor)))
    return {"chol_S_00": l00, "chol_S_10": l10, "chol_S_11": l11}


def chi2_probability(chi2) -> Column:
    """exp(−chi2/2) clipped away from 0 and 1; missing chi2 gives the lowest value."""
    p = F.when(finite(chi2), F.exp(-F.greatest(col(chi2), F.lit(0.0)) / F.lit(2.0)))
    return clip(F.coalesce(p, F.lit(0.0)), PROBABILITY_CLIP, 1.0 - PROBABILITY_CLIP)


def chi2_log_odds(chi2) -> Column:
    p = chi2_probability(chi2)
    return F.log(p / (F.lit(1.0) - p))


def extent_ratio(size, thickness, angle, pitch) -> Column:
    """Observed over expected cluster extent along one axis."""
    pitch = F.when(col(pitch).isNotNull(), F.greatest(col(pitch), F.lit(VARIANCE_FLOOR)))
    return col(size) / (F.lit(1.0) + col(thickness) * F.abs(F.tan(col(angle))) / pitch)


def charge_per_path(charge, thickness, alpha_u, alpha_v) -> Column:
    tu, tv = F.tan(col(alpha_u)), F.tan(col(alpha_v))
    path = col(thickness) * F.sqrt(F.lit(1.0) + tu * tu + tv * tv)
    return col(charge) / F.when(path.isNotNull(), F.greatest(path, F.lit(VARIANCE_FLOOR)))


def needed_window(r0, r1, s00, s11, is_1d) -> Column:
    """Smallest n whose box contains the residual; NULL where it is not finite."""
    d0 = F.when(col(s00) > 0, F.abs(col(r0)) / F.sqrt(col(s00)))
    d1 = F.when(col(s11) > 0, F.abs(col(r1)) / F.sqrt(col(s11)))
    both = F.when(d0.isNotNull() & d1.isNotNull(), F.greatest(d0, d1))
    return F.when(true(is_1d), d0).otherwise(both)


def transverse_momentum(qop, theta) -> Column:
    """|1/(q/p)|·sin(theta); NULL at q/p = 0."""
    return F.when(col(qop) != 0, F.abs(F.lit(1.0) / col(qop)) * F.sin(col(theta)))
