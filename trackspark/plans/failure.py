"""Candidate table to the failure cube."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import true
from ..operators import failure, resolve
from ..operators.truth import particle_pt
from ..session import cut_lineage


def failure_states(
    rows: DataFrame, point: failure.OperatingPoint | None = None, max_shared: int = 3, min_hits: int = 7
) -> DataFrame:
    """State table of the followed branches with purity and resolution flags.

    With an operating point, branches are first cut off where its hole limit stops them.
    """
    defined = cut_lineage(rows.where(~true("majority_undefined")), "defined")
    chosen = failure.followed_branch(defined)
    used = defined.join(chosen, ["event_id", "seed_id", "branch_id"], "left_semi")
    if point is not None:
        st = used.groupBy("event_id", "seed_id", "step_k").agg(
            *[F.min(c).alias(c) for c in ("state_theta", "volume_id", "state_qop")]
        )
        used = cut_lineage(failure.emulated_prefix(used, failure.emulate(used, st, point)), "prefix")
    pure = failure.branch_purity(used, chosen)
    kept = resolve.resolve_shared(used, max_shared, min_hits)
    key = ["event_id", "seed_id"]
    return (
        failure.state_table(used)
        .join(pure, key, "left")
        .join(kept, key, "left")
        .withColumns({"is_pure": F.coalesce("is_pure", F.lit(False)), "survived": F.coalesce("survived", F.lit(False))})
    )


def failure_cube(rows: DataFrame, simhits: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """The cube and its counters."""
    states = cut_lineage(failure_states(rows, **options), "states")
    pt = particle_pt(simhits)
    return failure.failure_cube(states, pt), failure.cube_counters(states, pt)
