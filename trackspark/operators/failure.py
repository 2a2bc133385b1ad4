"""Window and module failure, purity, operating-point emulation and material."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import beside, bin_index, count_if, finite, ratio, true
from ..functions.geometry import needed_window, pseudorapidity, transverse_momentum
from ..functions.stats import wilson
from ..functions.strata import (
    PT_EDGES,
    WINDOW_SIZES,
    eta_grid_index,
    is_hit,
    is_sensor,
    member,
    occupancy_index,
    pt_index,
    sensor_class,
)
from .ordered import CHUNK, CHUNK_WIDTH, exact_percentiles, first_n, in_chunks, passes_chunk, running

BRANCH = ("event_id", "seed_id", "branch_id")
SEED = ("event_id", "seed_id")
STATE = (*BRANCH, "step_k")
CUBE = ("eta_bin", "sensor", "is_pure", "occupancy", "pt_bin", "survived")
ETA_CLIP = 1e-10


@dataclass(frozen=True)
class OperatingPoint:
    """Cuts of one configuration."""

    chi2_max: float
    min_hits: int
    max_holes: int
    pt_min: float


# Cuts of the two published operating points.
OPERATING_POINTS = {
    "tight": OperatingPoint(16.255929655134203, 9, 1, 0.4597609399152028),
    "fast": OperatingPoint(15.401021709868644, 8, 1, 0.6215760132564532),
}


def is_true_hit() -> Column:
    return member("branch_majority_pid", "contrib_pids") & is_hit("cand_hit_id")


# --- branch choice and purity ------------------------------------------------------------


def followed_branch(rows: DataFrame) -> DataFrame:
    """Per seed the branch with most accepted rows, the lowest id on ties."""
    counts = rows.where(true("is_ckf_selected")).groupBy(*BRANCH).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*SEED).agg(F.min_by("branch_id", F.struct(-F.col("_n"), "branch_id")).alias("branch_id"))


def seed_purity(rows: DataFrame) -> DataFrame:
    """``pure`` when at least three of the first three accepted hits match, else ``majority``."""
    hits = rows.where(true("is_ckf_selected") & (F.col("cand_hit_id") != -1))
    head = first_n(hits, BRANCH, ["step_k", "cand_hit_id"], 3)
    same = F.sum(member("branch_majority_pid", "contrib_pids").cast("int"))
    return head.groupBy(*BRANCH).agg(
        F.when(same >= 3, F.lit("pure")).otherwise(F.lit("majority")).alias("seed_purity")
    )


def branch_purity(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """``is_pure``: every one of the first (up to) three accepted hits matches."""
    picked = rows.where(true("is_ckf_selected")).join(chosen.select(*BRANCH), list(BRANCH), "left_semi")
    head = first_n(picked, SEED, ["step_k", "cand_hit_id"], 3)
    return head.groupBy(*SEED).agg(F.min(member("branch_majority_pid", "contrib_pids")).alias("is_pure"))


def candidate_row_purity(rows: DataFrame) -> DataFrame:
    """Older rule: all of the first (up to) three non-hole rows match; an empty branch is pure."""
    head = first_n(rows.where(F.col("cand_hit_id") != -1), BRANCH, ["step_k", "cand_hit_id"], 3)
    pure = head.groupBy(*BRANCH).agg(F.min(member("branch_majority_pid", "contrib_pids")).alias("_p"))
    return (
        rows.select(*BRANCH)
        .distinct()
        .join(pure, list(BRANCH), "left")
        .select(*BRANCH, F.coalesce("_p", F.lit(True)).alias("is_pure"))
    )


# --- state table and cube ----------------------------------------------------------------


def state_table(rows: DataFrame) -> DataFrame:
    """One row per state with the distance of the nearest true hit."""
    hit = is_true_hit()
    d = needed_window("residual_l0", "residual_l1", "S00", "S11", "is_1d")
    keep = ("volume_id", "state_theta", "n_window", "branch_majority_pid")
    return rows.groupBy(*STATE).agg(
        *[F.min(c).alias(c) for c in keep],
        F.max(true("majority_true_hit_on_surface")).alias("on_surface"),
        F.min(F.when(hit, d)).alias("d_true"),
        count_if(hit).alias("n_true_rows"),
    )


def stratify(states: DataFrame) -> DataFrame:
    """Cube coordinates of each state; ``sensor`` is −1 outside the tracker volumes."""
    return states.withColumns(
        {
            "eta_bin": eta_grid_index(pseudorapidity("state_theta", ETA_CLIP)),
            "sensor": sensor_class("volume_id"),
            "occupancy": occupancy_index("n_window"),
            "pt_bin": pt_index("pt_gev"),
        }
    )


def failure_cube(states: DataFrame, pt: DataFrame, sizes: Sequence[float] = WINDOW_SIZES) -> DataFrame:
    """Module and window totals and failures per cube cell, all window sizes in one pass.

    ``states`` carry ``is_pure`` and ``survived``. Cubes of several events add up.
    """
    s = stratify(with_pt(states, pt)).where((F.col("sensor") >= 0) & F.col("eta_bin").isNotNull())
    on = F.col("on_surface")
    aggs = [
        F.count(F.lit(1)).alias("mod_total"),
        count_if(~on).alias("mod_fail"),
        count_if(on).alias("win_total"),
    ]
    for n in sizes:
        missed = F.col("d_true").isNull() | (F.col("d_true") > n)
        aggs.append(count_if(on & missed).alias(f"win_fail_{n:g}"))
    return s.groupBy(*CUBE).agg(*aggs)


def with_pt(states: DataFrame, pt: DataFrame) -> DataFrame:
    p = pt.select("event_id", F.col("particle_id").alias("branch_majority_pid"), "pt_gev")
    return states.join(p, ["event_id", "branch_majority_pid"], "left")


def cube_counters(states: DataFrame, pt: DataFrame) -> DataFrame:
    """Counts that accompany the cube: excluded, escaped, ambiguous and unmatched states."""
    s = with_pt(states, pt).withColumn("_sensor", sensor_class("volume_id") >= 0)
    per_seed = s.groupBy(*SEED).agg(F.max("survived").alias("_sv"))
    seeds = per_seed.agg(
        F.count(F.lit(1)).alias("n_branches"), count_if(F.col("_sv")).alias("n_survivors")
    )
    counts = s.agg(
        F.count(F.lit(1)).alias("n_states"),
        count_if(~F.col("_sensor")).alias("n_excluded"),
        count_if(F.col("_sensor") & F.col("on_surface") & F.col("d_true").isNull()).alias("n_escaped"),
        count_if(F.col("n_true_rows") > 1).alias("n_multi_true"),
        count_if(F.col("pt_gev").isNull()).alias("n_pt_unmatched"),
    )
    return beside(counts, seeds)


def slice_cube(
    cube: DataFrame, keep: Sequence[str], pt_min: float = 0.0, survivors_only: bool = False, where: Column | None = None
) -> DataFrame:
    """Sum the cube over everything but ``keep``; ``pt_min`` must be an edge of the pT axis."""
    if pt_min not in PT_EDGES:
        raise ValueError(f"pt threshold {pt_min} is not one of the edges {PT_EDGES}")
    c = cube.where(F.col("pt_bin") >= PT_EDGES.index(pt_min))
    if survivors_only:
        c = c.where(F.col("survived"))
    if where is not None:
        c = c.where(where)
    counts = [x for x in cube.columns if x not in CUBE]
    return c.groupBy(*keep).agg(*[F.sum(x).alias(x) for x in counts])


def with_rate(sliced: DataFrame, fail: str, total: str, prefix: str) -> DataFrame:
    """Failure rate with its one-sigma Wilson band."""
    lo, hi = wilson(fail, total)
    return sliced.withColumns(
        {f"{prefix}_rate": ratio(fail, total), f"{prefix}_lo": lo, f"{prefix}_hi": hi}
    )


# --- operating-point emulation -----------------------------------------------------------


def emulate(
    rows: DataFrame, states: DataFrame, point: OperatingPoint, width: int = CHUNK_WIDTH
) -> DataFrame:
    """Would each seed's branch pass the cuts once cut off at the hole limit?

    Holes are sensor states without an accepted row. The branch is kept up to the
    step at which the running hole count exceeds the limit (``cutoff_step``, NULL
    when never); chi2 and hit cuts apply to that prefix, pT to the first state.
    """
    taken = rows.where(true("is_ckf_selected"))
    per_step = taken.groupBy(*SEED, "step_k").agg(
        F.count(F.lit(1)).alias("_n"), F.max("chi2_inc").alias("_chi2")
    )
    s = states.select(*SEED, "step_k", "state_theta", "volume_id", "state_qop")
    s = s.join(per_step, [*SEED, "step_k"], "left")
    hole = (is_sensor("volume_id") & F.col("_n").isNull()).cast("long")
    passes = passes_chunk(states, "step_k", width)
    s = running(s.withColumn("_hole", hole), SEED, "step_k", sums={"_holes": "_hole"}, width=width, passes=passes)
    inside = F.col("_holes") <= point.max_holes
    g = s.groupBy(*SEED).agg(
        F.min(F.when(~inside, F.col("step_k"))).alias("cutoff_step"),
        F.coalesce(F.sum(F.when(inside, F.col("_n"))), F.lit(0)).alias("n_prefix_hits"),
        F.max(F.when(inside, F.col("_chi2"))).alias("_max_chi2"),
        F.min_by(F.struct("state_qop", "state_theta"), "step_k").alias("_first"),
    )
    pt = transverse_momentum(F.col("_first.state_qop"), F.col("_first.state_theta"))
    ok = (
        F.coalesce(F.col("_max_chi2") < point.chi2_max, F.lit(False))
        & (F.col("n_prefix_hits") >= point.min_hits)
        & finite(pt)
        & F.coalesce(pt > point.pt_min, F.lit(False))
    )
    return g.select(*SEED, ok.alias("passes_emulation"), "cutoff_step", "n_prefix_hits")


def emulated_prefix(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows of passing branches before their cutoff."""
    ok = verdicts.where("passes_emulation").select(*SEED, "cutoff_step")
    j = rows.join(ok, list(SEED), "inner")
    return j.where(F.col("cutoff_step").isNull() | (F.col("step_k") < F.col("cutoff_step"))).drop("cutoff_step")


# --- simple failure tables ---------------------------------------------------------------


def failure_by(
    rows: DataFrame, groups: Sequence[str], sizes: Sequence[float] = WINDOW_SIZES, need: Column | None = None
) -> DataFrame:
    """Failures of true hits per group and window size; rows with unknown distance are left out."""
    d = needed_window("residual_l0", "residual_l1", "S00", "S11", "is_1d") if need is None else need
    t = rows.where(is_true_hit() & ~true("majority_undefined")).withColumn("_d", d).where(F.col("_d").isNotNull())
    g = t.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("total"), *[count_if(F.col("_d") > n).alias(f"fail_{n:g}") for n in sizes]
    )
    return g.withColumns({f"rate_{n:g}": ratio(f"fail_{n:g}", "total") for n in sizes})


def module_failure(rows: DataFrame, density_edges: Sequence[float] = (2.0, 5.0, 10.0, 20.0)) -> DataFrame:
    """States whose surface lacks the branch particle, by η bin, pixel flag and hit density."""
    s = rows.where(~true("majority_undefined")).groupBy(*STATE).agg(
        F.min("state_theta").alias("state_theta"),
        F.max(true("is_pixel")).alias("is_pixel"),
        F.min("geometric_density").alias("geometric_density"),
        F.max(true("majority_true_hit_on_surface")).alias("on_surface"),
    )
    return (
        s.withColumns(
            {
                "eta_bin": eta_grid_index(pseudorapidity("state_theta", ETA_CLIP)),
                "density_bin": bin_index(F.coalesce("geometric_density", F.lit(0)), density_edges),
            }
        )
        .groupBy("eta_bin", "is_pixel", "density_bin")
        .agg(F.count(F.lit(1)).alias("mod_total"), count_if(~F.col("on_surface")).alias("mod_fail"))
    )


# --- material and branch summaries ----------------------------------------------------------


def cumulative_material(rows: DataFrame, width: int = CHUNK_WIDTH) -> DataFrame:
    """Material up to each state, every surface charged once whatever its number of candidates."""
    s = rows.groupBy(*STATE).agg(F.max(F.coalesce("pathInX0_interval", F.lit(0.0))).alias("_x"))
    return running(s, BRANCH, "step_k", sums={"cum_x0": "_x"}, width=width, passes=passes_chunk(rows, "step_k", width)).drop("_x")


def true_hit_distances(rows: DataFrame, width: int = CHUNK_WIDTH) -> DataFrame:
    """True candidate rows with both normalised distances, η and the material so far."""
    z = lambda r, s: F.when(F.col(s) > 0, F.abs(F.col(r)) / F.sqrt(F.col(s)))
    usable = finite("S00") & finite("residual_l0") & (true("is_1d") | (finite("S11") & finite("residual_l1")))
    t = rows.where(is_true_hit() & ~true("majority_undefined") & usable)
    t = t.join(cumulative_material(rows, width), list(STATE), "inner")
    return t.select(
        *STATE,
        "cand_hit_id",
        pseudorapidity("state_theta", 1e-9).alias("eta"),
        "n_window",
        "is_1d",
        z("residual_l0", "S00").alias("z0"),
        z("residual_l1", "S11").alias("z1"),
        "cum_x0",
    )


def censored_rates(distances: DataFrame, eta_edges: Sequence[float], sizes: Sequence[float]) -> DataFrame:
    """Per η bin: failure counts for each size and the mean material at true hits."""
    d = F.when(true("is_1d"), F.col("z0")).otherwise(F.greatest("z0", "z1"))
    return distances.groupBy(bin_index("eta", eta_edges[1:-1]).alias("eta_bin")).agg(
        F.count(F.lit(1)).alias("total"),
        *[count_if(d > n).alias(f"fail_{n:g}") for n in sizes],
        F.avg("cum_x0").alias("mean_x0"),
    )


def branch_summary(rows: DataFrame) -> DataFrame:
    """One row per branch: material, mean η, last step, any true hit, first-three counts."""
    s = rows.groupBy(*STATE).agg(
        F.max(F.coalesce("pathInX0_interval", F.lit(0.0))).alias("_x"),
        F.sum(pseudorapidity("state_theta", 1e-9)).alias("_e"),
        F.count(F.lit(1)).alias("_n"),
        F.max(is_true_hit() & ~true("majority_undefined")).alias("_t"),
    )
    whole = s.groupBy(*BRANCH).agg(
        F.sum("_x").alias("x0_total"),
        (F.sum("_e") / F.sum("_n")).alias("mean_eta"),
        F.max("step_k").alias("max_step"),
        F.max("_t").alias("has_true"),
        F.sum("_n").alias("n_rows"),
    )
    head = first_n(rows.where(F.col("cand_hit_id") != -1), BRANCH, ["step_k", "cand_hit_id"], 3)
    first = head.groupBy(*BRANCH).agg(
        F.count(F.lit(1)).alias("n_first"), count_if(is_true_hit()).alias("n_first_true")
    )
    j = whole.join(first, list(BRANCH), "left")
    return j.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_first", "n_first_true")})


def terminal_rows(rows: DataFrame) -> DataFrame:
    """Last state of each branch with its history counters and the branch's row count."""
    fields = ("n_hits", "n_holes", "n_seq_holes", "state_qop")
    last = F.max_by(F.struct(*fields), F.struct("step_k", "cand_hit_id"))
    return rows.groupBy(*BRANCH).agg(last.alias("_l"), F.count(F.lit(1)).alias("n_rows")).select(
        *BRANCH, *[F.col(f"_l.{f}").alias(f) for f in fields], "n_rows"
    )


def hole_cap_survival(terminal: DataFrame, caps: Mapping[str, int]) -> DataFrame:
    """Branch and row fractions below each configuration's hole limit."""
    table = F.array(*[F.struct(F.lit(n).alias("config"), F.lit(c).alias("cap")) for n, c in caps.items()])
    t = terminal.select("n_holes", "n_rows", F.explode(table).alias("c")).select("n_holes", "n_rows", "c.*")
    ok = F.col("n_holes") <= F.col("cap")
    return t.groupBy("config", "cap").agg(
        F.count(F.lit(1)).alias("n_branches"),
        count_if(ok).alias("n_surviving"),
        (count_if(ok) / F.count(F.lit(1))).alias("branch_fraction"),
        (F.coalesce(F.sum(F.when(ok, F.col("n_rows"))), F.lit(0)) / F.sum("n_rows")).alias("row_fraction"),
    )


# --- occupancy and distribution tables -----------------------------------------------------


def occupancy_by_window(rows: DataFrame, sizes: Sequence[float], cap: int = 200) -> DataFrame:
    """Candidates per state recomputed for each window size: states, rows and positives per count."""
    hit = F.col("cand_hit_id") != -1
    need = needed_window("residual_l0", "residual_l1", "S00", "S11", F.lit(False))
    label = (is_true_hit() & ~true("majority_undefined")).cast("long")
    per_state = (
        rows.where(hit)
        .select(*STATE, need.alias("_d"), label.alias("_y"), true("is_pixel").alias("is_pixel"))
        .where(F.col("_d").isNotNull())
        .groupBy(*STATE, "is_pixel")
        .agg(
            F.array(
                *[
                    F.struct(
                        F.lit(float(n)).alias("window_n"),
                        count_if(F.col("_d") <= n).alias("size"),
                        F.coalesce(F.sum(F.when(F.col("_d") <= n, F.col("_y"))), F.lit(0)).alias("pos"),
                    )
                    for n in sizes
                ]
            ).alias("_w")
        )
    )
    w = per_state.select("is_pixel", F.explode("_w").alias("w")).select("is_pixel", "w.*").where("size > 0")
    return w.groupBy("window_n", F.least("size", F.lit(cap - 1)).alias("n_in_window"), "is_pixel").agg(
        F.count(F.lit(1)).alias("n_states"), F.sum("size").alias("n_rows"), F.sum("pos").alias("n_pos")
    )


def in_window_counts(rows: DataFrame, flag: Column, out: str) -> DataFrame:
    """Per-state count of rows that satisfy ``flag``, on every row."""
    from .expand import window_counts

    return window_counts(rows, STATE, flag, out)


def log_histogram(rows: DataFrame, value: str, by: Mapping[str, Column], lo=-3.0, hi=3.0, n=200) -> DataFrame:
    """Counts of a positive value on a log10 grid, by group; values outside the grid are left out."""
    x = F.log10(F.col(value))
    step = (hi - lo) / n
    inside = (F.col(value) > 0) & (x >= lo) & (x <= hi)
    b = F.least(F.floor((x - F.lit(lo)) / F.lit(step)), F.lit(n - 1)).cast("int")
    return rows.where(inside).groupBy(b.alias("bin"), *[c.alias(k) for k, c in by.items()]).agg(
        F.count(F.lit(1)).alias("count")
    )


def event_summary(rows: DataFrame) -> DataFrame:
    """Per event: row count, hole / undefined / positive fractions, medians and 2σ outlier flags."""
    hole = F.col("cand_hit_id") == -1
    label = is_true_hit() & ~true("majority_undefined")
    defined = ~hole & ~true("majority_undefined")
    g = rows.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("total_rows"),
        (count_if(hole) / F.count(F.lit(1))).alias("hole_fraction"),
        (count_if(true("majority_undefined")) / F.count(F.lit(1))).alias("undefined_fraction"),
        F.coalesce(ratio(count_if(label), count_if(defined)), F.lit(0.0)).alias("positive_fraction"),
    )
    cand = rows.where(~hole)
    nw = exact_percentiles(cand, "n_window", [0.5], by=["event_id"]).select(
        "event_id", F.col("value").alias("median_n_window")
    )
    chi2 = exact_percentiles(cand.where(F.col("chi2_inc") > 0), "chi2_inc", [0.5], by=["event_id"]).select(
        "event_id", F.col("value").alias("median_chi2")
    )
    g = g.join(nw, ["event_id"], "left").join(chi2, ["event_id"], "left")
    return outlier_flags(g, [c for c in g.columns if c != "event_id"])


def outlier_flags(g: DataFrame, columns: Sequence[str], sigmas: float = 2.0) -> DataFrame:
    """Comma-separated names of columns more than ``sigmas`` deviations from their mean."""
    m = g.agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns],
        *[F.stddev_samp(c).alias(f"_s_{c}") for c in columns],
        *[F.count(c).alias(f"_n_{c}") for c in columns],
    )
    out = [
        F.when(
            (F.col(f"_n_{c}") > 2)
            & (F.col(f"_s_{c}") > 0)
            & (F.abs(F.col(c) - F.col(f"_m_{c}")) > F.col(f"_s_{c}") * sigmas),
            F.lit(c),
        )
        for c in columns
    ]
    return beside(g, m).select(*g.columns, F.concat_ws(", ", *out).alias("outlier_flags"))


def binned_means(
    df: DataFrame, value: str, edges: Sequence[float], means: Sequence[str], by: Sequence[str] = (), min_count: int = 1
) -> DataFrame:
    """Mean of each column per bin (ends clipped); NULL below ``min_count`` rows."""
    b = bin_index(value, list(edges)[1:-1]).alias("bin")
    n = F.count(F.lit(1))
    return df.groupBy(*by, b).agg(
        n.alias("count"), *[F.when(n >= min_count, F.avg(m)).alias(f"mean_{m}") for m in means]
    )


def layer_means(df: DataFrame, means: Sequence[str]) -> DataFrame:
    """Row-weighted means per volume and layer over all events."""
    return df.groupBy("volume_id", "layer_id").agg(
        F.count(F.lit(1)).alias("total_count"), *[F.avg(m).alias(f"mean_{m}") for m in means]
    )


def volume_scores(df: DataFrame, score: str, label: str, threshold: float = 0.5) -> DataFrame:
    """Acceptance, purity, recall and mean score per volume."""
    hi, y = F.col(score) >= threshold, F.col(label) == 1
    g = df.groupBy("volume_id").agg(
        F.count(F.lit(1)).alias("n"),
        count_if(y).alias("n_pos"),
        count_if(hi).alias("n_acc"),
        count_if(hi & y).alias("n_acc_pos"),
        F.avg(score).alias("mean_score"),
    )
    return g.withColumns(
        {
            "acceptance": ratio("n_acc", "n"),
            "purity": F.coalesce(ratio("n_acc_pos", "n_acc"), F.lit(0.0)),
            "recall": F.coalesce(ratio("n_acc_pos", "n_pos"), F.lit(0.0)),
        }
    )


def hole_counter_mismatch(states: DataFrame, passive: Sequence[int], width: int = CHUNK_WIDTH) -> DataFrame:
    """Hole counters under three rules: all states, sensors only, sensors with a reset on passives.

    ``states``: one row per state with ``n_window`` and ``volume_id``.
    """
    hit = F.col("n_window") > 0
    dead = F.col("volume_id").isin(list(passive))
    s = states.withColumns({"_all": (~hit).cast("long"), "_sens": (~hit & ~dead).cast("long")})
    sums = {"nh_all": "_all", "nh_sensor": "_sens"}
    passes = passes_chunk(states, "step_k", width)
    s = in_chunks(s, BRANCH, "step_k", width)
    s = running(s, BRANCH, "step_k", sums=sums, inclusive=False, width=width, passes=passes)
    marks = {
        "_a": F.when(hit, F.col("nh_all")),
        # A passive surface with a candidate count is still no hit under this rule.
        "_b": F.when(hit & ~dead, F.col("nh_sensor")),
        "_c": F.when((hit & ~dead) | dead, F.col("nh_sensor")),
    }
    s = running(s, BRANCH, "step_k", lasts=marks, inclusive=False, width=width, passes=passes)
    zero = F.lit(0)
    return s.withColumns(
        {
            "seq_all": F.col("nh_all") - F.coalesce("_a", zero),
            "seq_sensor": F.col("nh_sensor") - F.coalesce("_b", zero),
            "seq_reset": F.col("nh_sensor") - F.coalesce("_c", zero),
            "d_holes": F.col("nh_all") - F.col("nh_sensor"),
        }
    ).drop("_all", "_sens", "_a", "_b", "_c", CHUNK)


# --- event bootstrap ---------------------------------------------------------------------


def event_cells(df: DataFrame, label: str, chi2_bin: Column, occ_bin: Column) -> DataFrame:
    """Rows and positives per event and (chi2, occupancy) cell."""
    return df.groupBy("event_id", chi2_bin.alias("chi2_bin"), occ_bin.alias("occ_bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("k")
    )


def contingency(cells: DataFrame) -> DataFrame:
    return cells.groupBy("chi2_bin", "occ_bin").agg(
        F.sum("n").alias("n_rows"),
        F.sum("k").alias("n_correct"),
        (F.sum("k") / F.sum("n")).alias("frac"),
        F.count(F.lit(1)).alias("n_events"),
    )


def bootstrap_multiplicity(cells: DataFrame, n_boot: int, seed: int = 0) -> DataFrame:
    """How often each event is drawn in each replica (as many draws as events, with replacement)."""
    from .ordered import row_index
    from .sampling import uniform_hash

    events = row_index(cells.select("event_id").distinct(), "event_id", "_i")
    n = events.count()
    draws = events.select(F.col("_i").alias("_d"), F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("boot"))
    pick = F.least(F.floor(uniform_hash(seed, "boot", "_d") * n), F.lit(n - 1)).cast("long")
    times = draws.groupBy("boot", pick.alias("_i")).agg(F.count(F.lit(1)).alias("times"))
    return times.join(events, ["_i"], "inner").select("boot", "event_id", "times")


def bootstrap_fractions(cells: DataFrame, multiplicity: DataFrame) -> DataFrame:
    """Cell fraction of every replica, from the pre-aggregated event cells."""
    j = cells.join(multiplicity, ["event_id"], "inner")
    return j.groupBy("boot", "chi2_bin", "occ_bin").agg(
        (F.sum(F.col("k") * F.col("times")) / F.sum(F.col("n") * F.col("times"))).alias("frac")
    )


def bootstrap_bands(fractions: DataFrame) -> DataFrame:
    """Standard deviation and 95 % interval per cell."""
    keys = ["chi2_bin", "occ_bin"]
    q = exact_percentiles(fractions, "frac", [0.025, 0.975], by=keys)
    bands = q.groupBy(*keys).agg(
        F.max(F.when(F.col("q") < 0.5, F.col("value"))).alias("frac_lo"),
        F.max(F.when(F.col("q") > 0.5, F.col("value"))).alias("frac_hi"),
    )
    return fractions.groupBy(*keys).agg(F.stddev_samp("frac").alias("frac_std")).join(bands, keys, "inner")


def log_odds_lines(cells: DataFrame, centres: Sequence[float]) -> DataFrame:
    """Straight line of log-odds against the chi2 bin centre, per occupancy bin."""
    from ..functions.stats import log_odds

    x = F.element_at(F.array(*[F.lit(float(c)) for c in centres]), F.col("chi2_bin") + 1)
    p = contingency(cells).select("occ_bin", x.alias("x"), log_odds("frac").alias("y"))
    return p.groupBy("occ_bin").agg(
        F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept")
    )


def separation(fractions: DataFrame, sparse: int, dense: int) -> DataFrame:
    """Log-odds of the sparse minus the dense occupancy bin per replica, averaged over chi2 bins."""
    from ..functions.stats import log_odds

    y = fractions.groupBy("boot", "chi2_bin").agg(
        F.max(F.when(F.col("occ_bin") == sparse, log_odds("frac"))).alias("_s"),
        F.max(F.when(F.col("occ_bin") == dense, log_odds("frac"))).alias("_d"),
    )
    return y.groupBy("boot").agg(F.avg(F.col("_s") - F.col("_d")).alias("separation"))
