"""State tables, logged and rollout targets, state classes and worklists.

Every function takes candidate rows keyed by ``event_id, seed_id, branch_id,
step_k``; several events may share a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import beside, clip, count_if, finite, true
from ..functions.geometry import chi2_log_odds, pseudorapidity
from ..functions.strata import is_hit, member, selected_outcome
from ..session import cut_lineage
from .ordered import CHUNK, CHUNK_WIDTH, exact_percentiles, first_n, in_chunks, passes_chunk, running, shifted

BRANCH = ("event_id", "seed_id", "branch_id")
STATE = (*BRANCH, "step_k")
SEED_STATE = ("event_id", "seed_id", "step_k")
ANCHORS = ("divergence", "tip")


def step_table(rows: DataFrame) -> DataFrame:
    """One row per state: accepted hit correct / wrong, particle present on the surface."""
    correct, wrong = selected_outcome(
        "is_ckf_selected", "cand_hit_id", "branch_majority_pid", "contrib_pids"
    )
    return rows.groupBy(*STATE).agg(
        F.max(correct).alias("sel_correct"),
        F.max(wrong).alias("sel_wrong"),
        F.max(true("majority_true_hit_on_surface")).alias("maj_hit_on_surface"),
        F.max("branch_majority_pid").alias("branch_majority_pid"),
    )


def past_counts(rows: DataFrame, keys=("event_id", "seed_id"), width: int = CHUNK_WIDTH) -> DataFrame:
    """Correct and wrong accepted hits up to and including each state."""
    correct, wrong = selected_outcome(
        "is_ckf_selected", "cand_hit_id", "branch_majority_pid", "contrib_pids"
    )
    states = (
        rows.where(~true("majority_undefined"))
        .groupBy(*keys, "step_k")
        .agg(F.max(correct).alias("_c"), F.max(wrong).alias("_w"))
    )
    passes = passes_chunk(rows, "step_k", width)
    out = running(states, keys, "step_k", sums={"n_correct": "_c", "n_wrong": "_w"}, width=width, passes=passes)
    return out.drop("_c", "_w")


def future_counts(
    steps: DataFrame, flag: str, out: str, keys=BRANCH, width: int = CHUNK_WIDTH, passes: Column | None = None
) -> DataFrame:
    """Flagged states strictly after each state."""
    s = steps.withColumn("_f", true(flag).cast("long"))
    return running(
        s, keys, "step_k", sums={out: "_f"}, inclusive=False, descending=True, width=width, passes=passes
    ).drop("_f")


def logged_targets(steps: DataFrame, totals: DataFrame, width: int = CHUNK_WIDTH) -> DataFrame:
    """Completeness, purity and their minimum for both tiers of the logged target.

    ``totals``: event_id, particle_id, n_total. An unknown total gives NULL targets.
    """
    t = totals.select("event_id", F.col("particle_id").alias("branch_majority_pid"), "n_total")
    s = steps.withColumn("_m", true("maj_hit_on_surface").cast("long"))
    passes = passes_chunk(steps, "step_k", width)
    s = in_chunks(s, BRANCH, "step_k", width)
    s = running(
        s,
        BRANCH,
        "step_k",
        sums={"n_correct": "sel_correct", "n_wrong": "sel_wrong", "_seen": "_m"},
        width=width,
        passes=passes,
    )
    s = future_counts(s, "maj_hit_on_surface", "n_findable_t2", width=width, passes=passes)
    s = s.join(t, ["event_id", "branch_majority_pid"], "left")
    left = F.col("n_total") - F.col("_seen")
    s = s.withColumn("n_findable_t1", F.when(left.isNotNull(), F.greatest(left, F.lit(0))))

    def scores(findable: str):
        shared = F.col("n_correct") + F.col(findable)
        track = shared + F.col("n_wrong")
        comp = clip(F.when(F.col("n_total") > 0, shared / F.col("n_total")), 0.0, 1.0)
        pure = clip(F.when(track > 0, shared / track).otherwise(F.lit(0.0)), 0.0, 1.0)
        return comp, pure, F.when(comp.isNotNull() & shared.isNotNull(), F.least(comp, pure))

    comp, pure, t2 = scores("n_findable_t2")
    _, _, t1 = scores("n_findable_t1")
    return s.withColumns({"completeness": comp, "purity": pure, "vstar_t2": t2, "vstar_t1": t1}).withColumn(
        "tier_invariant_violated",
        F.coalesce(F.col("vstar_t1") < F.col("vstar_t2") - 1e-12, F.lit(False)),
    ).drop("_m", "_seen", CHUNK)


def valid_targets(targets: DataFrame) -> DataFrame:
    """Rows with a known target and consistent tiers."""
    return targets.where(F.col("vstar_t2").isNotNull() & ~F.col("tier_invariant_violated"))


def majority_defined(rows: DataFrame, branches: DataFrame, keys=("event_id", "seed_id")) -> DataFrame:
    """Rows of branches whose majority is defined."""
    ok = branches.where(~true("majority_undefined")).select(*keys).distinct()
    return rows.join(ok, list(keys), "left_semi")


def value_features(rows: DataFrame, width: int = CHUNK_WIDTH) -> DataFrame:
    """Per-state features of the value model.

    The sum and minimum of log-odds run over accepted hits only; holes keep the
    running minimum and a branch without hits reports 0.
    """
    accepted = true("is_ckf_selected") & (F.col("cand_hit_id") != -1)
    fields = {
        "state_theta": "state_theta",
        "state_qop": "state_qop",
        "sigma2_l0": "cov_00",
        "sigma2_l1": "cov_06",
        "n_hits": "n_hits",
        "n_holes": "n_holes",
        "n_seq_holes": "n_seq_holes",
        "pathInX0_interval": "pathInX0_interval",
    }
    s = rows.groupBy(*STATE).agg(
        *[F.min(src).alias(name) for name, src in fields.items()],
        F.max(F.when(accepted, chi2_log_odds("chi2_inc"))).alias("step_logodds"),
    )
    s = running(
        s,
        BRANCH,
        "step_k",
        sums={
            "sum_gate_logodds": F.coalesce("step_logodds", F.lit(0.0)),
            "x0_accumulated": F.coalesce("pathInX0_interval", F.lit(0.0)),
        },
        mins={"min_gate_logodds": "step_logodds"},
        width=width,
        passes=passes_chunk(rows, "step_k", width),
    )
    return s.withColumns(
        {
            "min_gate_logodds": F.coalesce("min_gate_logodds", F.lit(0.0)),
            "eta": pseudorapidity("state_theta"),
        }
    )


# --- state classes and worklist -----------------------------------------------------


def truth_pick(rows: DataFrame, keys=SEED_STATE) -> DataFrame:
    """The truth hit with the lowest chi2, then the lowest id, of each state."""
    truth = (
        member("branch_majority_pid", "contrib_pids") & ~true("majority_undefined") & is_hit("cand_hit_id")
    )
    return rows.where(truth).groupBy(*keys).agg(
        F.min(F.struct(F.col("chi2_inc").isNull().alias("late"), "chi2_inc", "cand_hit_id"))
        .getField("cand_hit_id")
        .alias("truth_pick")
    )


def classify_states(rows: DataFrame, width: int = CHUNK_WIDTH) -> DataFrame:
    """collapse / divergence / tip: does the next accepted hit equal the next truth pick?"""
    truth = (
        member("branch_majority_pid", "contrib_pids") & ~true("majority_undefined") & is_hit("cand_hit_id")
    )
    best = F.min(
        F.when(truth, F.struct(F.col("chi2_inc").isNull().alias("late"), "chi2_inc", "cand_hit_id"))
    )
    s = rows.groupBy(*SEED_STATE).agg(
        count_if(truth).alias("n_truth"),
        F.min("volume_id").alias("volume_id"),
        F.coalesce(F.min(F.when(true("is_ckf_selected"), F.col("cand_hit_id"))), F.lit(-1)).alias("sel_hit"),
        F.coalesce(best.getField("cand_hit_id"), F.lit(-1)).alias("truth_pick"),
    )
    following = {"_next_sel": "sel_hit", "_next_pick": "truth_pick"}
    s = shifted(s, ["event_id", "seed_id"], "step_k", following, width=width, passes=passes_chunk(rows, "step_k", width))
    cls = (
        F.when(F.col("_next_sel").isNull(), F.lit("tip"))
        .when(F.col("_next_sel") == F.col("_next_pick"), F.lit("collapse"))
        .otherwise(F.lit("divergence"))
    )
    return s.withColumn("state_class", cls).drop("_next_sel", "_next_pick")


def surface_map(measured: DataFrame, detectors: DataFrame) -> DataFrame:
    """(volume, layer, module) → surface id; measured ids win over the detector list.

    Passive surfaces (module 0) are left out.
    """
    from ..functions.ids import decode_surface

    def triples(df: DataFrame, priority: int) -> DataFrame:
        return df.select(
            *decode_surface("geometry_id"), F.lit(priority).alias("_p"), F.col("geometry_id").cast("long").alias("_g")
        ).where(F.col("module_id") > 0)

    both = triples(measured, 0).unionByName(triples(detectors, 1))
    return both.groupBy("volume_id", "layer_id", "module_id").agg(
        F.min(F.struct("_p", "_g")).getField("_g").alias("true_gid")
    )


def filtered_else_predicted(states: DataFrame, names: list[str]) -> DataFrame:
    """Filtered value, or the predicted one where the filtered is missing."""
    return states.withColumns(
        {
            n: F.coalesce(
                F.when(finite(f"{n}_flt"), F.col(f"{n}_flt")), F.when(finite(f"{n}_prt"), F.col(f"{n}_prt"))
            )
            for n in names
        }
    )


def last_sensitive(
    states: DataFrame, values: list[str], keys=("event_id", "seed_id"), order="step_k", width: int = CHUNK_WIDTH
) -> DataFrame:
    """On surfaces without a true id, take id and parameters of the last earlier sensitive state."""
    on = F.col("true_gid").isNotNull()
    donor = F.when(on, F.struct("true_gid", *values))
    s = running(states, keys, order, lasts={"_donor": donor}, width=width)
    return s.withColumns({c: F.col(f"_donor.{c}") for c in ("true_gid", *values)}).drop("_donor")


def worklist(
    classes: DataFrame,
    states: DataFrame,
    surfaces: DataFrame,
    majority: DataFrame,
    parameters: list[str],
    variances: list[str],
    width: int = CHUNK_WIDTH,
) -> tuple[DataFrame, DataFrame]:
    """Rollout starts at divergence and tip states, and a one-row join report.

    ``states`` hold the coalesced parameters with volume, layer and module.
    """
    values = [*parameters, *variances]
    located = states.join(surfaces, ["volume_id", "layer_id", "module_id"], "left")
    donors = last_sensitive(located, values, width=width).select(*SEED_STATE, "true_gid", *values)
    work = (
        classes.where(F.col("state_class").isin(*ANCHORS))
        .select(*SEED_STATE)
        .join(donors, list(SEED_STATE), "left")
        .join(majority.select("event_id", "seed_id", "branch_majority_pid"), ["event_id", "seed_id"], "left")
        .where(F.col("branch_majority_pid") >= 0)
    )
    bad_par, bad_gid = ~finite(parameters[0]), F.col("true_gid").isNull()
    report = work.agg(
        F.count(F.lit(1)).alias("n_states"),
        count_if(bad_par).alias("n_missing_parameters"),
        count_if(bad_gid).alias("n_missing_surface"),
        count_if(~(bad_par | bad_gid)).alias("n_kept"),
    )
    kept = work.where(~(bad_par | bad_gid)).select(
        *SEED_STATE,
        F.col("true_gid").alias("geometry_id"),
        *[F.col(p).alias(f"par{i}") for i, p in enumerate(parameters)],
        *[(F.col(v) * F.col(v)).alias(f"var{i}") for i, v in enumerate(variances)],
        F.col("branch_majority_pid").alias("majority_pid"),
    )
    return kept, report


def require_join(report: DataFrame, minimum: float = 0.95) -> None:
    """Raise when a worklist join lost too many states."""
    r = report.first()
    if r.n_states and r.n_kept < minimum * r.n_states:
        raise ValueError(f"worklist join kept {r.n_kept} of {r.n_states} states: {r.asDict()}")


# --- rollout targets ------------------------------------------------------------------


def rollout_futures(hits: DataFrame, work: DataFrame) -> DataFrame:
    """Findable hits and holes of each rollout, with the state it started from."""
    counts = hits.groupBy("event_id", "rollout_id").agg(
        count_if(F.col("meas_id") >= 0).alias("n_findable"),
        count_if(F.col("meas_id") < 0).alias("n_future_holes"),
    )
    return counts.join(
        work.select("event_id", "rollout_id", "seed_id", "step_k"), ["event_id", "rollout_id"], "left"
    )


def rollout_targets(
    classes: DataFrame, futures: DataFrame, past: DataFrame, totals: DataFrame, width: int = CHUNK_WIDTH, open_ends: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Targets composed backwards from the anchor states, and the dropped-branch report.

    Going from the tip to the seed, an anchor sets the number of findable hits
    from its rollout; every earlier state adds one if its child took a hit. A
    branch with any missing rollout, past count or total is dropped as a whole
    and counted under the first reason that applies. A branch whose last state is
    no tip is refused, as its states cannot be composed; with ``open_ends`` it is
    dropped and counted too.
    """
    keys = ["event_id", "seed_id"]
    s = (
        classes.select(*SEED_STATE, "state_class", "sel_hit")
        .join(futures.select(*SEED_STATE, "n_findable"), list(SEED_STATE), "left")
        .join(past.select(*SEED_STATE, "n_correct", "n_wrong"), list(SEED_STATE), "left")
        .join(totals.select(*keys, F.col("n_total").alias("n_total_true")), keys, "left")
        .withColumn("_anchor", F.col("state_class").isin(*ANCHORS))
    )
    s = cut_lineage(s, "rollout")
    passes = passes_chunk(s, "step_k", width)
    why = (
        F.when(count_if(F.col("_anchor") & F.col("n_findable").isNull()) > 0, F.lit("missing_rollout"))
        .when(count_if(F.col("n_correct").isNull()) > 0, F.lit("missing_past"))
        .when(count_if(F.coalesce(F.col("n_total_true") <= 0, F.lit(True))) > 0, F.lit("missing_total"))
    )
    branches = s.groupBy(*keys).agg(
        why.alias("reason"),
        F.max_by("state_class", "step_k").alias("_last"),
        F.count(F.lit(1)).alias("n_states"),
    )
    if not open_ends:
        bad = branches.where(F.col("_last") != "tip").select(*keys, "_last").limit(5).collect()
        if bad:
            raise ValueError(f"branches that end without a tip: {[tuple(r) for r in bad]}")
    reason = F.when(F.col("_last") != "tip", F.lit("last_state_not_tip")).otherwise(F.col("reason"))
    branches = branches.withColumn("reason", reason)
    report = (
        branches.where(F.col("reason").isNotNull())
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("n_branches"), F.sum("n_states").alias("n_states"))
    )
    good = s.join(branches.where(F.col("reason").isNull()).select(*keys), keys, "left_semi")
    good = in_chunks(good, keys, "step_k", width)
    good = shifted(good, keys, "step_k", {"_child": "sel_hit"}, width=width, passes=passes)
    step = F.when(F.col("_anchor"), F.lit(0)).otherwise(
        F.coalesce((F.col("_child") >= 0).cast("long"), F.lit(0))
    )
    good = running(good, keys, "step_k", sums={"_sum": step}, descending=True, width=width, passes=passes)
    mark = F.when(F.col("_anchor"), F.col("n_findable") - F.col("_sum"))
    good = running(good, keys, "step_k", lasts={"_base": mark}, descending=True, width=width, passes=passes)
    findable = F.col("_base") + F.col("_sum")
    found = F.col("n_correct") + findable
    size = found + F.col("n_wrong")
    comp = found / F.col("n_total_true")
    pure = F.when(size > 0, found / size).otherwise(F.lit(0.0))
    out = good.select(
        *SEED_STATE, findable.alias("n_findable_full"), clip(F.least(comp, pure), 0.0, 1.0).alias("vstar_rollout")
    )
    return out, report


def suffix_check(classes: DataFrame, rollout: DataFrame, logged: DataFrame, value="vstar_t2", tol=0.01):
    """Disagreement of both targets on branches that never diverge (one row)."""
    keys = ["event_id", "seed_id"]
    diverged = classes.where(F.col("state_class") == "divergence").select(*keys).distinct()
    diff = (
        rollout.join(diverged, keys, "left_anti")
        .join(logged.select(*SEED_STATE, value), list(SEED_STATE), "inner")
        .select(F.abs(F.col("vstar_rollout") - F.col(value)).alias("d"))
    )
    stats = diff.agg(
        F.count(F.lit(1)).alias("n_states_compared"),
        F.avg((F.col("d") > tol).cast("double")).alias("disagree_rate"),
        F.avg("d").alias("mean_abs_diff"),
        F.max("d").alias("max_abs_diff"),
    )
    q = exact_percentiles(diff, "d", [0.5, 0.9, 0.99]).agg(
        *[
            F.max(F.when(F.col("q") == p, F.col("value"))).alias(f"p{round(100 * p)}_abs_diff")
            for p in (0.5, 0.9, 0.99)
        ]
    )
    n = classes.select(*keys).distinct().join(diverged, keys, "left_anti").agg(
        F.count(F.lit(1)).alias("n_suffix_branches")
    )
    return beside(beside(stats, q), n)


def require_agreement(report: DataFrame, limit: float = 0.01) -> None:
    r = report.first()
    if r.n_states_compared and r.disagree_rate > limit:
        raise ValueError(f"targets disagree on {r.disagree_rate:.2%} of {r.n_states_compared} states")


def attach_targets(states: DataFrame, targets: DataFrame, window_nsigma: float) -> tuple[DataFrame, DataFrame]:
    """States with their rollout target and a constant window column; misses are counted."""
    j = states.join(targets.select(*SEED_STATE, "vstar_rollout"), list(SEED_STATE), "left")
    report = j.agg(
        F.count(F.lit(1)).alias("n_states"), count_if(F.col("vstar_rollout").isNull()).alias("n_missing")
    )
    kept = j.where(F.col("vstar_rollout").isNotNull()).withColumn("window_nsigma", F.lit(float(window_nsigma)))
    return kept, report


def compare_rollout_windows(narrow: DataFrame, wide: DataFrame) -> DataFrame:
    """Per-rollout counts of two windows: equal keys, never fewer in the wide one, some more."""
    keys = ["event_id", "rollout_id"]
    a = narrow.select(*keys, F.col("n_findable").alias("n_narrow"))
    b = wide.select(*keys, F.col("n_findable").alias("n_wide"))
    j = a.join(b, keys, "full_outer")
    return j.agg(
        F.count(F.lit(1)).alias("n_rollouts"),
        count_if(F.col("n_narrow").isNull() | F.col("n_wide").isNull()).alias("n_unpaired"),
        count_if(F.col("n_narrow") > F.col("n_wide")).alias("n_decreased"),
        count_if(F.col("n_narrow") < F.col("n_wide")).alias("n_increased"),
    )


def rollout_coverage(manifest: DataFrame, futures: DataFrame) -> DataFrame:
    """Per expected event: rollouts, findable total, and whether it is missing or empty."""
    f = futures.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("n_rollouts"), F.sum("n_findable").alias("n_findable")
    )
    j = manifest.select("event_id").distinct().join(f, ["event_id"], "left")
    return j.select(
        "event_id",
        F.coalesce("n_rollouts", F.lit(0)).alias("n_rollouts"),
        F.coalesce("n_findable", F.lit(0)).alias("n_findable"),
        F.col("n_rollouts").isNull().alias("is_missing"),
        F.coalesce(F.col("n_findable") == 0, F.lit(False)).alias("is_empty"),
    )


def first_hits(rows: DataFrame, n: int, keys=BRANCH) -> DataFrame:
    """First ``n`` accepted hits of each branch."""
    hits = rows.where(true("is_ckf_selected") & (F.col("cand_hit_id") != -1))
    return first_n(hits, keys, ["step_k", "cand_hit_id"], n)
