"""Labels and strata as column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import bin_index, col, true

# Sensor class of each tracker volume (0 pixel, 1 short strip, 2 long strip).
SENSOR_CLASS = {16: 0, 17: 0, 18: 0, 23: 1, 24: 1, 25: 1, 28: 2, 29: 2, 30: 2}
SENSOR_CLASS_NAMES = ("pixel", "sstrip", "lstrip")
PASSIVE_VOLUMES = (20,)
# Stratum edges.
ETA_GRID = (-3.5, 3.5, 140)
OCCUPANCY_EDGES = (0.0, 2.0, 5.0, 10.0, 20.0)
PT_EDGES = (0.0, 0.7, 0.9, 1.0)
WINDOW_SIZES = (3.0, 5.0, 7.0, 10.0)
ETA_EDGES = (-3.0, -1.8, -0.6, 0.6, 1.8, 3.0)
ABS_ETA_EDGES = (0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 4.0)
OCCUPANCY_LABELS = (("n=1 (isolated)", 1), ("n=2-3", 3), ("n=4-6", 6), ("n=7+", 2**31 - 1))


def member(particle, contributors) -> Column:
    """Is the particle among the contributors? A NULL list means none."""
    return F.coalesce(F.array_contains(col(contributors), col(particle)), F.lit(False))


def is_hit(cand) -> Column:
    return col(cand) >= 0


def label_columns(
    contributors="contrib_pids",
    majority="branch_majority_pid",
    undefined="majority_undefined",
    cand="cand_hit_id",
) -> dict[str, Column]:
    """Truth label, merged-cluster flag and trainable mask of a candidate row."""
    return {
        "label_same_particle": member(majority, contributors).cast("int"),
        "label_ambiguous": F.coalesce(F.size(F.coalesce(col(contributors), F.array())) > 1, F.lit(False)),
        "gate_row_mask": ~true(undefined) & (col(cand) != -1),
    }


def selected_outcome(selected, cand, majority, contributors) -> tuple[Column, Column]:
    """(correct, wrong) of an accepted hit; a hole is neither."""
    taken = true(selected) & is_hit(cand)
    same = member(majority, contributors)
    return (taken & same).cast("int"), (taken & ~same).cast("int")


def sensor_class(volume) -> Column:
    """0/1/2 for pixel, short strip, long strip; −1 outside the tracker volumes."""
    out = F.lit(-1)
    for cls in (2, 1, 0):
        volumes = [v for v, c in SENSOR_CLASS.items() if c == cls]
        out = F.when(col(volume).isin(volumes), F.lit(cls)).otherwise(out)
    return out


def is_sensor(volume) -> Column:
    return col(volume).isin(list(SENSOR_CLASS))


def eta_grid_index(eta) -> Column:
    lo, hi, n = ETA_GRID
    step = (hi - lo) / n
    return bin_index(eta, [lo + i * step for i in range(1, n)])


def occupancy_index(n_window) -> Column:
    return bin_index(F.coalesce(col(n_window).cast("double"), F.lit(0.0)), OCCUPANCY_EDGES[1:])


def pt_index(pt) -> Column:
    return bin_index(F.coalesce(col(pt).cast("double"), F.lit(0.0)), PT_EDGES[1:])


def range_label(x, edges: Sequence[float], fmt: str, close_last: bool = True) -> Column:
    """Label of the bin holding x; NULL outside the edges."""
    x = col(x)
    out = F.lit(None).cast("string")
    last = len(edges) - 2
    for i in reversed(range(len(edges) - 1)):
        lo, hi = edges[i], edges[i + 1]
        upper = (x <= hi) if (close_last and i == last) else (x < hi)
        out = F.when((x >= lo) & upper, F.lit(fmt.format(lo, hi))).otherwise(out)
    return out


def eta_stratum(eta) -> Column:
    return range_label(eta, ETA_EDGES, "eta[{:+.1f},{:+.1f}]")


def abs_eta_stratum(eta) -> Column:
    return range_label(F.abs(col(eta)), ABS_ETA_EDGES, "|eta|[{:.1f},{:.1f})")


def occupancy_stratum(n_window) -> Column:
    """Stratum of an integer occupancy; NULL below 1."""
    n, out = col(n_window), F.lit(None).cast("string")
    for label, upper in reversed(OCCUPANCY_LABELS):
        out = F.when(n <= upper, F.lit(label)).otherwise(out)
    return F.when(n >= 1, out)


def sensor_flags(volume, pixel: Iterable[int] = (16, 17, 18), barrel: Iterable[int] | None = None):
    """``is_pixel`` and ``is_barrel``; barrel is NULL unless its volumes are named."""
    is_pixel = col(volume).isin(list(pixel))
    if barrel is None:
        return is_pixel, F.lit(None).cast("boolean")
    return is_pixel, F.when(col(volume) > 0, col(volume).isin(list(barrel)))


def double_majority(purity, completeness) -> Column:
    return F.coalesce((col(purity) >= 0.5) & (col(completeness) >= 0.5), F.lit(False))


def rollout_accepts(particle, contributors, chi2, n) -> Column:
    """Truth hit of the branch particle inside the rollout ellipse."""
    from .geometry import in_ellipse

    return member(particle, contributors) & in_ellipse(chi2, n)
