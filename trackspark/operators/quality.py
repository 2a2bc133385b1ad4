"""Audits, guards and profiles of candidate tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import beside, bin_index, count_if, finite, ratio, true
from ..functions.strata import PASSIVE_VOLUMES, SENSOR_CLASS, SENSOR_CLASS_NAMES, member
from .ordered import exact_percentiles, first_n, in_chunks, passes_chunk, running, shifted
from .truth import mode_by

SEED = ("event_id", "seed_id")
STATE = (*SEED, "step_k")


def orientation(states: DataFrame) -> DataFrame:
    """Per event: do path lengths run outward from step 0? (three fractions)

    ``states``: event_id, track_nr, step_k, path_length. Steps without a finite
    length are skipped.
    """
    s = states.where(finite("path_length"))
    keys = ["event_id", "track_nr"]
    two = first_n(s, keys, ["step_k"], 2).groupBy(*keys).agg(
        F.min_by("path_length", "step_k").alias("_first"),
        F.max_by("path_length", "step_k").alias("_second"),
        F.count(F.lit(1)).alias("_n"),
    )
    last = s.groupBy(*keys).agg(F.max_by("path_length", "step_k").alias("_last"))
    j = two.join(last, keys, "inner")
    share = lambda c: F.avg(c.cast("double"))
    up = F.when(F.col("_n") > 1, (F.col("_second") > F.col("_first") + 1e-6).cast("double"))
    return j.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("n_tracks"),
        share(F.abs("_first") < 1e-3).alias("frac_seed_at_zero"),
        share(F.col("_last") > F.col("_first") + 1e-6).alias("frac_outer_above"),
        F.coalesce(F.avg(up), F.lit(1.0)).alias("frac_first_step_up"),
    )


def require_orientation(report: DataFrame, minimum: float = 0.99) -> None:
    names = ("frac_seed_at_zero", "frac_outer_above", "frac_first_step_up")
    bad = report.where(F.least(*names) < minimum).limit(1).collect()
    if bad:
        raise ValueError(f"states are not in propagation order: {bad[0].asDict()}")


def source_agreement(rows: DataFrame, source: DataFrame) -> DataFrame:
    """States compared with their source by (volume, layer): joined, mismatched, unjoined (one row)."""
    s = rows.groupBy(*STATE).agg(F.min("volume_id").alias("volume_id"), F.min("layer_id").alias("layer_id"))
    r = source.select(
        "event_id",
        F.col("track_nr").alias("seed_id"),
        "step_k",
        F.col("volume_id").alias("_v"),
        F.col("layer_id").alias("_l"),
    )
    j = s.join(r, list(STATE), "left")
    found = F.col("_v").isNotNull()
    differs = found & ((F.col("volume_id") != F.col("_v")) | (F.col("layer_id") != F.col("_l")))
    return j.agg(
        count_if(found).alias("n_joined"), count_if(differs).alias("n_mismatch"), count_if(~found).alias("n_unjoined")
    )


def hole_fraction(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    s = rows.groupBy(*by, *[k for k in STATE if k not in by]).agg(F.max("cand_hit_id").alias("_c"))
    return s.groupBy(*by).agg(F.avg((F.col("_c") < 0).cast("double")).alias("hole_fraction"))


def candidate_shares(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of candidates per sensor class."""
    from ..functions.strata import sensor_class

    c = rows.where(F.col("cand_hit_id") >= 0).withColumn("_s", sensor_class("volume_id"))
    return c.groupBy(*by).agg(
        *[F.avg((F.col("_s") == i).cast("double")).alias(n) for i, n in enumerate(SENSOR_CLASS_NAMES)]
    )


def volume_presence(rows: DataFrame) -> DataFrame:
    """Candidate and overall volumes against the expected ones (one row).

    Only distinct volumes are gathered: at most a few hundred by the id's 8 bits.
    """
    arr = lambda vs: F.array(*[F.lit(int(v)) for v in sorted(vs)]).cast("array<long>")
    g = rows.agg(
        F.array_sort(F.collect_set(F.when(F.col("cand_hit_id") >= 0, F.col("volume_id")).cast("long"))).alias("cand"),
        F.array_sort(F.collect_set(F.col("volume_id").cast("long"))).alias("seen"),
    )
    expected, passive = arr(SENSOR_CLASS), arr(PASSIVE_VOLUMES)
    return g.select(
        F.array_except(expected, "cand").alias("missing_sensitive"),
        F.array_except("seen", F.array_union(expected, passive)).alias("unexpected"),
        F.array_except(passive, "seen").alias("missing_passive"),
    )


def history_consistency(states: DataFrame) -> DataFrame:
    """States whose hit + hole counters differ from their position or fall (one row)."""
    passes = passes_chunk(states, "step_k")
    s = running(in_chunks(states, SEED, "step_k"), SEED, "step_k", sums={"_pos": F.lit(1)}, inclusive=False, passes=passes)
    s = shifted(s, SEED, "step_k", {"_prev": "n_hits"}, forward=False, passes=passes)
    return s.agg(
        F.count(F.lit(1)).alias("n_states"),
        count_if(F.col("n_hits") + F.col("n_holes") != F.col("_pos")).alias("n_bad_total"),
        count_if(F.col("n_hits") < F.col("_prev")).alias("n_falling"),
    )


def majority_agreement(rows: DataFrame) -> DataFrame:
    """Stored branch particle against the mode of the first three accepted hits (one row)."""
    sel = rows.where(true("is_ckf_selected") & (F.col("cand_hit_id") >= 0))
    head = first_n(sel, SEED, ["step_k", "cand_hit_id"], 3).where(F.size(F.coalesce("contrib_pids", F.array())) > 0)
    flat = head.select(*STATE, F.explode("contrib_pids").alias("_p"))
    primary = mode_by(flat, list(STATE), "_p", "_primary")
    top = mode_by(primary, list(SEED), "_primary", "_pid", "_n")
    size = primary.groupBy(*SEED).agg(F.count(F.lit(1)).alias("_size"))
    ok = (F.col("_size") >= 3) & (F.col("_n") >= 2)
    redone = top.join(size, list(SEED), "inner").select(
        *SEED, F.when(ok, F.col("_pid")).otherwise(F.lit(-1)).alias("recomputed_pid")
    )
    stored = rows.where(~true("majority_undefined")).groupBy(*SEED).agg(
        F.min("branch_majority_pid").alias("branch_majority_pid")
    )
    j = stored.join(redone, list(SEED), "left")
    same = F.col("branch_majority_pid") == F.coalesce("recomputed_pid", F.lit(-1))
    return j.agg(F.count(F.lit(1)).alias("n_branches"), F.avg(same.cast("double")).alias("agreement"))


def selected_flag(rows: DataFrame, source: DataFrame) -> DataFrame:
    """States with several accepted rows, and accepted source states with exactly one (one row)."""
    n = rows.groupBy(*STATE).agg(count_if(true("is_ckf_selected")).alias("_n"))
    multi = n.agg(count_if(F.col("_n") > 1).alias("n_multiple"))
    meas = source.where(true("has_measurement")).select("event_id", F.col("track_nr").alias("seed_id"), "step_k")
    j = meas.join(n, list(STATE), "inner").agg(
        F.count(F.lit(1)).alias("n_accepted"),
        F.coalesce(F.avg((F.col("_n") == 1).cast("double")), F.lit(1.0)).alias("joinable"),
    )
    return beside(multi, j)


def target_range(rows: DataFrame, value: str = "vstar_soft") -> DataFrame:
    ok = finite(value)
    return rows.agg(
        count_if(ok & ((F.col(value) < 0) | (F.col(value) > 1))).alias("n_outside"),
        F.avg(ok.cast("double")).alias("finite_fraction"),
    )


def _check(name: str, df: DataFrame, passed: Column, value: Column, detail: Column) -> DataFrame:
    return df.select(
        F.lit(name).alias("name"),
        F.coalesce(passed, F.lit(False)).alias("passed"),
        value.cast("double").alias("value"),
        detail.alias("detail"),
    )


def audit(
    rows: DataFrame,
    source: DataFrame,
    reference: DataFrame | None = None,
    tolerance: float = 0.02,
    min_agreement: float = 0.98,
    min_joinable: float = 0.95,
    min_orientation: float = 0.99,
) -> DataFrame:
    """Nine checks as rows (name, passed, value, detail)."""
    states = rows.groupBy(*STATE).agg(F.min("n_hits").alias("n_hits"), F.min("n_holes").alias("n_holes"))
    worst = F.least("frac_seed_at_zero", "frac_outer_above", "frac_first_step_up")
    o = orientation(source).agg(F.min(worst).alias("w"), F.sum("n_tracks").alias("n"))
    checks = [
        _check("order", o, F.col("w") >= min_orientation, F.col("w"), F.format_string("%d tracks", F.col("n"))),
    ]
    a = source_agreement(rows, source)
    checks.append(
        _check(
            "source_agreement",
            a,
            (F.col("n_mismatch") == 0) & (F.col("n_unjoined") == 0),
            F.col("n_mismatch") / F.greatest("n_joined", F.lit(1)),
            F.format_string("%d mismatched, %d unjoined", "n_mismatch", "n_unjoined"),
        )
    )
    v = volume_presence(rows)
    empty = (F.size("missing_sensitive") == 0) & (F.size("unexpected") == 0) & (F.size("missing_passive") == 0)
    checks.append(
        _check(
            "volumes",
            v,
            empty,
            F.size("missing_sensitive"),
            F.concat_ws(
                "; ",
                F.concat(F.lit("missing "), F.concat_ws(",", F.col("missing_sensitive").cast("array<string>"))),
                F.concat(F.lit("unexpected "), F.concat_ws(",", F.col("unexpected").cast("array<string>"))),
            ),
        )
    )
    h = hole_fraction(rows)
    s = candidate_shares(rows)
    if reference is None:
        checks.append(_check("hole_fraction", h, F.lit(True), F.col("hole_fraction"), F.lit("no reference")))
        checks.append(
            _check("candidate_shares", s, F.least(*SENSOR_CLASS_NAMES) > 0, F.col("pixel"), F.lit("no reference"))
        )
    else:
        r = hole_fraction(reference).withColumnRenamed("hole_fraction", "_r")
        hr = beside(h, r)
        checks.append(
            _check(
                "hole_fraction",
                hr,
                F.abs(F.col("hole_fraction") - F.col("_r")) <= tolerance,
                F.col("hole_fraction"),
                F.format_string("reference %.4f", F.col("_r")),
            )
        )
        rs = candidate_shares(reference)
        rs = rs.select(*[F.col(n).alias(f"_r_{n}") for n in SENSOR_CLASS_NAMES])
        gap = F.greatest(*[F.abs(F.col(n) - F.col(f"_r_{n}")) for n in SENSOR_CLASS_NAMES])
        checks.append(
            _check("candidate_shares", beside(s, rs), gap <= tolerance, gap, F.lit("largest gap to reference"))
        )
    c = history_consistency(states)
    checks.append(
        _check(
            "history",
            c,
            (F.col("n_bad_total") == 0) & (F.col("n_falling") == 0),
            F.col("n_bad_total") / F.greatest("n_states", F.lit(1)),
            F.format_string("%d wrong totals, %d falling", "n_bad_total", "n_falling"),
        )
    )
    m = majority_agreement(rows)
    checks.append(
        _check(
            "majority_label",
            m,
            F.coalesce("agreement", F.lit(1.0)) >= min_agreement,
            F.col("agreement"),
            F.format_string("%d branches", "n_branches"),
        )
    )
    f = selected_flag(rows, source)
    checks.append(
        _check(
            "selected_flag",
            f,
            (F.col("n_multiple") == 0) & (F.col("joinable") >= min_joinable),
            F.col("joinable"),
            F.format_string("%d states with several accepted rows", "n_multiple"),
        )
    )
    t = target_range(rows)
    checks.append(
        _check(
            "target_range",
            t,
            F.col("n_outside") == 0,
            F.col("finite_fraction"),
            F.format_string("%d outside [0, 1]", "n_outside"),
        )
    )
    out = checks[0]
    for x in checks[1:]:
        out = out.unionByName(x)
    return out


# --- sweeps and profiles ---------------------------------------------------------------------


def purity_sweep(rows: DataFrame, one_d_volumes=(28, 29, 30), n: float = 10.0) -> DataFrame:
    """Per event counts of trainable rows by covariance health, box violations and mean occupancy."""
    keep = ~true("majority_undefined") & (F.col("cand_hit_id") != -1)
    y = member("branch_majority_pid", "contrib_pids")
    lost = ~finite("S11")
    flat = F.col("volume_id").isin(list(one_d_volumes))
    groups = {"clean": ~lost, "true1d": flat, "corrupt": lost & ~flat}
    aggs = [
        F.count(F.lit(1)).alias("n_rows"),
        count_if(F.col("action_taken") == 0).alias("n_cand"),
        count_if(keep).alias("n_trainable"),
        count_if(keep & y).alias("n_pos"),
    ]
    for name, mask in groups.items():
        aggs += [count_if(keep & mask).alias(f"n_{name}"), count_if(keep & mask & y).alias(f"n_{name}_pos")]
    outside = F.abs("residual_l1") > F.sqrt(F.abs("S11")) * n
    aggs += [
        count_if(keep & ~finite("S00")).alias("n_s00_missing"),
        count_if(keep & ~lost & outside).alias("n_box_violations"),
        F.coalesce(F.avg(F.when(keep, F.col("n_window"))), F.lit(0.0)).alias("mean_n_window"),
    ]
    return rows.groupBy("event_id").agg(*aggs)


def corrupt_by_volume(rows: DataFrame, one_d_volumes=(28, 29, 30)) -> DataFrame:
    keep = ~true("majority_undefined") & (F.col("cand_hit_id") != -1)
    bad = ~finite("S11") & ~F.col("volume_id").isin(list(one_d_volumes))
    return rows.where(keep & bad).groupBy("event_id", "volume_id").agg(F.count(F.lit(1)).alias("n_corrupt"))


def profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column: nulls, finite and non-zero counts, range and mean of numeric ones.

    All columns are summarised in one aggregation and then turned into rows.
    """
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    types = dict(df.dtypes)
    names = [c for c in columns or df.columns if types[c] in numeric]
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in names:
        x = F.when(finite(c), F.col(c).cast("double"))
        aggs += [
            F.count(c).alias(f"{c}__known"),
            F.count(x).alias(f"{c}__finite"),
            count_if(x != 0).alias(f"{c}__nonzero"),
            F.min(x).alias(f"{c}__min"),
            F.max(x).alias(f"{c}__max"),
            F.avg(x).alias(f"{c}__mean"),
        ]
    one = df.agg(*aggs)
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            (F.col("_n") - F.col(f"{c}__known")).alias("n_null"),
            F.col(f"{c}__finite").alias("n_finite"),
            F.col(f"{c}__nonzero").alias("n_nonzero"),
            F.col(f"{c}__min").alias("min"),
            F.col(f"{c}__max").alias("max"),
            F.col(f"{c}__mean").alias("mean"),
        )
        for c in names
    ]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def top_values(df: DataFrame, column: str, k: int = 8) -> DataFrame:
    """The ``k`` most frequent values (a top-k report)."""
    g = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return g.orderBy(F.col("n").desc(), F.col(column)).limit(k)


def cluster_probe(clusters: DataFrame, n_cells: DataFrame | None = None) -> DataFrame:
    """Are cluster features degenerate? Statistics and verdict (one row)."""
    names = ("clus_s_u", "clus_s_v", "clus_q_tot", "clus_sigma_uu", "clus_sigma_vv")
    aggs = [F.count(F.lit(1)).alias("n_measurements")]
    for c in names:
        x = F.when(finite(c), F.col(c))
        aggs += [F.avg(x).alias(f"{c}_mean"), F.min(x).alias(f"{c}_min"), F.max(x).alias(f"{c}_max")]
        aggs += [F.avg((x > 1.0).cast("double")).alias(f"{c}_frac_gt1")]
    aggs.append(F.stddev_pop("clus_q_tot").alias("_q_std"))
    aggs.append(F.avg(finite("clus_q_tot").cast("double")).alias("_q_finite"))
    g = clusters.agg(*aggs)
    size = (F.col("clus_s_u_max") <= 1) & (F.col("clus_s_v_max") <= 1)
    charge = ((F.col("_q_std") < 1e-12) & (F.col("clus_q_tot_mean") <= 0)) | (F.col("_q_finite") == 0)
    moments = (F.col("clus_sigma_uu_max") == 0) & (F.col("clus_sigma_vv_max") == 0) & size
    g = g.withColumns({"size_degenerate": size, "charge_degenerate": charge, "moments_degenerate": moments})
    ok = (F.col("n_measurements") > 0) & ~size & ~charge & (F.col("_q_finite") > 0.9)
    return g.withColumn("passed", F.coalesce(ok, F.lit(False))).drop("_q_std", "_q_finite")


def saturation(df: DataFrame, value: str = "chi2_inc", limit: float = 27.6) -> DataFrame:
    """Largest chi2 and how many rows lie beyond the point where its probability is clipped."""
    x = F.when(finite(value), F.col(value))
    return df.agg(
        F.count(x).alias("n_known"),
        F.max(x).alias("max_chi2"),
        count_if(x > limit).alias("n_saturated"),
        F.coalesce(ratio(count_if(x > limit), F.count(x)), F.lit(0.0)).alias("frac_saturated"),
    )


def field_report(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Presence, non-null and finite counts of required columns."""
    types = dict(df.dtypes)
    here = [c for c in required if c in types]
    one = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count(c).alias(f"k_{c}") for c in here],
        *[count_if(F.isnan(c)).alias(f"x_{c}") for c in here if types[c] in ("double", "float")],
    )
    rows = []
    for c in required:
        there = c in types
        nan = F.col(f"x_{c}") if there and types[c] in ("double", "float") else F.lit(0).cast("long")
        rows.append(
            F.struct(
                F.lit(c).alias("field"),
                F.lit(there).alias("present"),
                (F.col(f"k_{c}") if there else F.lit(0).cast("long")).alias("n_known"),
                nan.alias("n_nan"),
            )
        )
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def differs_from_baseline(df: DataFrame, baseline: DataFrame) -> DataFrame:
    """Rows only in one of two tables, as multisets (one row of counts)."""
    a = df.exceptAll(baseline).agg(F.count(F.lit(1)).alias("n_only_new"))
    b = baseline.exceptAll(df).agg(F.count(F.lit(1)).alias("n_only_baseline"))
    return beside(a, b)


def correlation_summary(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Quantiles of rho and of the chi2 difference per region."""
    by = list(by)
    parts = []
    for name in ("rho", "chi2_delta"):
        q = exact_percentiles(df, name, [0.1, 0.5, 0.9], by=by)
        parts.append(
            q.groupBy(*by).agg(
                *[F.max(F.when(F.col("q") == p, F.col("value"))).alias(f"{name}_p{round(p * 100)}") for p in (0.1, 0.5, 0.9)]
            )
        )
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs("rho")).alias("mean_abs_rho"))
    return n.join(parts[0], by, "left").join(parts[1], by, "left")


def density_quintiles(df: DataFrame, density: str = "geometric_density", delta: str = "chi2_delta") -> DataFrame:
    """Per quintile of the density: its limits, rows, mean and median of ``delta``.

    Edges are exact quantiles, each nudged above the one before; rows without a density go to the last quintile,
    as a comparison with NaN leaves them there. Quintiles without rows are listed with NULL metrics.
    """
    from .calibration import quantile_edges

    edges = quantile_edges(df, density, 5, nudge=1e-9)
    placed = df.withColumn("quintile", F.coalesce(bin_index(density, edges[1:-1]).cast("int"), F.lit(4)))
    sums = placed.groupBy("quintile").agg(F.count(F.lit(1)).alias("n"), F.avg(delta).alias("mean_delta"))
    median = exact_percentiles(placed, delta, [0.5], by=["quintile"]).select("quintile", F.col("value").alias("median_delta"))
    limits = df.sparkSession.createDataFrame([(i, float(edges[i]), float(edges[i + 1])) for i in range(5)], "quintile int, geom_lo double, geom_hi double")
    j = limits.join(sums, ["quintile"], "left").join(median, ["quintile"], "left")
    return j.select("quintile", "geom_lo", "geom_hi", F.coalesce("n", F.lit(0)).alias("n"), "mean_delta", "median_delta")


# Limits below which the diagonal approximation is safe.
SAFE_SPREAD, SAFE_RHO, SAFE_RANK = 0.1, 0.2, 0.05
RANKED_ROWS = 10


def correlation_verdict(df: DataFrame, density: str = "geometric_density", delta: str = "chi2_delta", rho: str = "rho") -> DataFrame:
    """One row: spread of the quintiles' mean deltas, median of |rho|, rank correlation, and whether all are small enough."""
    from .calibration import rank_correlation

    q = density_quintiles(df, density, delta).agg((F.max("mean_delta") - F.min("mean_delta")).alias("spread"))
    m = exact_percentiles(df.select(F.abs(rho).alias("_r")), "_r", [0.5]).agg(F.max("value").alias("rho_median_abs"))
    r = rank_correlation(df, density, delta)
    ranked = r.select(F.when(F.col("n") > RANKED_ROWS, F.col("spearman")).alias("rank_correlation"))
    v = beside(beside(q, m), ranked)
    small = F.col("rank_correlation").isNull() | (F.abs("rank_correlation") < SAFE_RANK)
    safe = F.coalesce((F.col("spread") < SAFE_SPREAD) & (F.col("rho_median_abs") < SAFE_RHO) & small, F.lit(False))
    return v.withColumn("safe", safe)
