"""Track-to-particle matching, efficiency and fake rates, conversions and comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import beside, count_if, finite, ratio, true
from ..functions.strata import double_majority
from ..session import cut_lineage
from .ordered import bucket_count, first_n, range_boundaries, with_bucket
from .truth import mode_by

TRACK = ("event_id", "track_nr")
MODULE = ("volume_id", "layer_id", "module_id")
# Track classes that count as matched.
MATCHED, DUPLICATE = 1, 2
SEED_CATEGORY = {3: "3/3 (pure seed)", 2: "2/3 (one outlier)", 1: "1/3 (no majority)"}


def module_totals(*runs: DataFrame) -> DataFrame:
    """Distinct modules per particle over the union of all runs (the shared denominator)."""
    keys = [r.where(F.col("pid") != 0).select("event_id", "pid", *MODULE) for r in runs]
    both = keys[0]
    for k in keys[1:]:
        both = both.unionByName(k)
    return both.distinct().groupBy("event_id", "pid").agg(F.count(F.lit(1)).alias("total_hits"))


def match_tracks(states: DataFrame, totals: DataFrame) -> DataFrame:
    """Majority particle of each track with purity, completeness and category."""
    valid = states.where(F.col("pid") != 0)
    size = valid.groupBy(*TRACK).agg(F.count(F.lit(1)).alias("n_meas"))
    top = mode_by(valid, list(TRACK), "pid", "majority_pid", "majority_count")
    j = top.join(size, list(TRACK), "inner").join(
        totals.withColumnRenamed("pid", "majority_pid"), ["event_id", "majority_pid"], "left"
    )
    j = j.withColumns(
        {
            "purity": F.col("majority_count") / F.col("n_meas"),
            "completeness": F.col("majority_count") / F.col("total_hits"),
        }
    )
    category = (
        F.when(F.col("purity") < 0.5, F.lit("low_purity"))
        .when(F.col("completeness") < 0.5, F.lit("low_completeness"))
        .otherwise(F.lit("matched"))
    )
    return j.withColumn("category", category)


def match_summary(matched: DataFrame, states: DataFrame) -> DataFrame:
    """Counts per category with mean purity and completeness (one row)."""
    dm = double_majority("purity", "completeness")
    per_pid = matched.where(dm).select("event_id", "majority_pid").distinct()
    n_tracks = states.select(*TRACK).distinct().agg(F.count(F.lit(1)).alias("n_tracks"))
    n_particles = per_pid.agg(F.count(F.lit(1)).alias("n_particles"))
    counts = (
        matched.agg(
            count_if(dm).alias("n_matched"),
            count_if(F.col("category") == "low_purity").alias("n_low_purity"),
            count_if(F.col("category") == "low_completeness").alias("n_low_completeness"),
            F.avg("purity").alias("mean_purity"),
            F.avg("completeness").alias("mean_completeness"),
        )
    )
    return beside(beside(counts, n_tracks), n_particles)


def compare_matched(left: DataFrame, right: DataFrame) -> DataFrame:
    """Matched particles shared by two runs and found by one only, with the recovery share."""
    def found(m: DataFrame, flag: str) -> DataFrame:
        ok = m.where(double_majority("purity", "completeness"))
        return ok.select("event_id", "majority_pid").distinct().withColumn(flag, F.lit(True))

    j = found(left, "_l").join(found(right, "_r"), ["event_id", "majority_pid"], "full_outer")
    a, b = F.coalesce("_l", F.lit(False)), F.coalesce("_r", F.lit(False))
    g = j.agg(
        count_if(a).alias("n_left"),
        count_if(b).alias("n_right"),
        count_if(a & b).alias("n_shared"),
        count_if(a & ~b).alias("n_left_only"),
        count_if(~a & b).alias("n_right_only"),
    )
    return g.withColumn("recovery", F.coalesce(ratio("n_shared", "n_left"), F.lit(0.0)))


def seed_conversion(states: DataFrame, order: str = "state_idx") -> DataFrame:
    """Per track: seed and whole-track majority, conversion flag, purity and completeness."""
    meas = states.where(F.col("pid") != 0)
    keys = list(TRACK)
    full = mode_by(meas, keys, "pid", "full_maj_pid", "full_maj_count")
    head = first_n(meas, keys, [order], 3)
    seed = mode_by(head, keys, "pid", "seed_maj_pid", "seed_maj_count")
    size = meas.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_meas"))
    totals = module_totals(states).withColumnRenamed("pid", "full_maj_pid")
    own = (
        meas.select(*keys, F.col("pid").alias("full_maj_pid"), *MODULE)
        .distinct()
        .groupBy(*keys, "full_maj_pid")
        .agg(F.count(F.lit(1)).alias("unique_maj_meas"))
    )
    t = (
        full.join(seed, keys, "inner")
        .join(size, keys, "inner")
        .where(F.col("n_meas") >= 3)
        .join(own, [*keys, "full_maj_pid"], "left")
        .join(totals, ["event_id", "full_maj_pid"], "left")
    )
    category = F.coalesce(*[F.when(F.col("seed_maj_count") == n, F.lit(v)) for n, v in SEED_CATEGORY.items()])
    t = t.withColumns(
        {
            "purity": F.col("full_maj_count") / F.col("n_meas"),
            "completeness": F.col("unique_maj_meas") / F.col("total_hits"),
            "converted": F.col("seed_maj_pid") != F.col("full_maj_pid"),
            "seed_category": category,
        }
    )
    return t.withColumn("dm_matched", double_majority("purity", "completeness"))


def conversion_table(tracks: DataFrame, survivors: DataFrame | None = None) -> DataFrame:
    """Conversions per seed category; with ``survivors`` also those left after resolution."""
    t = tracks
    if survivors is not None:
        kept = survivors.select(*TRACK).distinct().withColumn("_s", F.lit(True))
        t = t.join(kept, list(TRACK), "left").withColumn("survived", F.coalesce("_s", F.lit(False)))
    c, dm = F.col("converted"), F.col("dm_matched")
    pure = F.col("purity") >= 0.5
    aggs = [
        F.count(F.lit(1)).alias("n_tracks"),
        count_if(c).alias("n_converted"),
        count_if(pure).alias("n_pure"),
        count_if(c & pure).alias("n_converted_pure"),
        count_if(dm).alias("n_matched"),
        count_if(c & dm).alias("n_converted_matched"),
    ]
    if survivors is not None:
        aggs.append(count_if(dm & F.col("survived")).alias("n_matched_survived"))
        aggs.append(count_if(c & dm & F.col("survived")).alias("n_converted_survived"))
    return t.groupBy("seed_category").agg(*aggs)


def truth_window_failure(
    states: DataFrame, sizes: Sequence[float], by: Sequence[str] = (), order: str = "state_idx"
) -> DataFrame:
    """Share of majority-particle states whose truth lies outside the window, per size."""
    meas = states.where((F.col("pid") != 0) & F.col("truth_l0").isNotNull() & F.col("truth_l1").isNotNull())
    top = mode_by(meas, list(TRACK), "pid", "_maj")
    m = meas.join(top, list(TRACK), "inner").where(F.col("pid") == F.col("_maj"))
    w = lambda s: F.sqrt(F.greatest(F.col(s), F.lit(0.0)))
    r0, r1 = F.abs(F.col("truth_l0") - F.col("pred_l0")), F.abs(F.col("truth_l1") - F.col("pred_l1"))
    m = m.select(*by, r0.alias("_r0"), r1.alias("_r1"), w("S00").alias("_w0"), w("S11").alias("_w1"))
    m = m.withColumn("window_n", F.explode(F.array(*[F.lit(float(n)) for n in sizes])))
    out = (F.col("_r0") > F.col("window_n") * F.col("_w0")) | (F.col("_r1") > F.col("window_n") * F.col("_w1"))
    return m.groupBy(*by, "window_n").agg(
        F.count(F.lit(1)).alias("total"),
        count_if(out).alias("outside"),
        (count_if(out) / F.count(F.lit(1))).alias("rate"),
    )


# --- efficiency and fake rate -------------------------------------------------------------


def matched_from_tracks(particles: DataFrame, tracks: DataFrame) -> DataFrame:
    """Particles with a flag: is any matched or duplicate track theirs?"""
    good = tracks.where(F.col("track_class").isin(MATCHED, DUPLICATE))
    keys = good.select("event_id", F.col("majority_pid").alias("particle_id")).distinct()
    return particles.join(keys.withColumn("_m", F.lit(True)), ["event_id", "particle_id"], "left").withColumn(
        "matched", F.coalesce("_m", F.lit(False))
    ).drop("_m")


def rates_by_cut(particles: DataFrame, tracks: DataFrame, cuts: Sequence[float]) -> DataFrame:
    """Efficiency and fake rate (percent) for particles above each pT cut.

    A track is good when it is matched or duplicate to a particle above the cut.
    Each side is aggregated per interval between cuts first; the cumulative sums
    then run over one row per cut.
    """
    cuts = sorted(cuts)
    from ..functions.expr import bin_index

    level = lambda c: bin_index(c, cuts)  # number of cuts passed
    p = particles.groupBy(level("pt").alias("level")).agg(
        F.count(F.lit(1)).alias("n"), count_if(true("matched")).alias("m")
    )
    pt = particles.select("event_id", F.col("particle_id").alias("majority_pid"), F.col("pt").alias("_pt"))
    good = F.col("track_class").isin(MATCHED, DUPLICATE)
    t = (
        tracks.join(pt, ["event_id", "majority_pid"], "left")
        .withColumn("_p", F.coalesce("_pt", "track_pt"))
        .groupBy(level("_p").alias("level"))
        .agg(F.count(F.lit(1)).alias("nt"), count_if(good).alias("g"))
    )
    j = p.join(t, p["level"].eqNullSafe(t["level"]), "full_outer").select(
        F.coalesce(p["level"], t["level"]).alias("level"), "n", "m", "nt", "g"
    )
    table = F.array(*[F.struct(F.lit(i + 1).alias("need"), F.lit(float(c)).alias("pt_cut")) for i, c in enumerate(cuts)])
    x = j.select("*", F.explode(table).alias("c")).select("level", "n", "m", "nt", "g", "c.*")
    above = F.col("level") >= F.col("need")
    s = lambda c: F.coalesce(F.sum(F.when(above, F.col(c))), F.lit(0))
    g = x.groupBy("pt_cut").agg(
        s("n").alias("n_particles"), s("m").alias("_m"), s("g").alias("_g"), F.sum("nt").alias("_nt")
    )
    return g.select(
        "pt_cut",
        "n_particles",
        (ratio("_m", "n_particles") * 100).alias("efficiency"),
        ((F.lit(1.0) - ratio("_g", "_nt")) * 100).alias("fakerate"),
    )


def track_quality(particles: DataFrame, tracks: DataFrame, pt_min: float = 1.0) -> DataFrame:
    """Purity and completeness of each matched track with a particle above ``pt_min``."""
    p = particles.select(
        "event_id", F.col("particle_id").alias("majority_pid"), F.col("pt").alias("_pt"), F.col("n_hits").alias("_nh")
    )
    j = tracks.where(F.col("track_class").isin(MATCHED, DUPLICATE)).join(p, ["event_id", "majority_pid"], "inner")
    size = F.col("n_measurements") + F.col("n_outliers")
    return j.where((F.col("_pt") >= pt_min) & (size > 0) & (F.col("_nh") > 0)).select(
        "event_id",
        "track_nr",
        (F.col("n_majority_hits") / size).alias("purity"),
        (F.col("n_majority_hits") / F.col("_nh")).alias("completeness"),
    )


def quality_summary(quality: DataFrame) -> DataFrame:
    """Means over tracks and over events, the latter with standard errors (one row)."""
    per_event = quality.groupBy("event_id").agg(
        F.avg("purity").alias("p"),
        F.avg("completeness").alias("c"),
        F.count(F.lit(1)).alias("n"),
        F.sum("purity").alias("sp"),
        F.sum("completeness").alias("sc"),
    )
    sem = lambda c: F.stddev_samp(c) / F.sqrt(F.count(c))
    return per_event.agg(
        F.count(F.lit(1)).alias("n_events"),
        F.sum("n").alias("n_tracks"),
        (F.sum("sp") / F.sum("n")).alias("mean_purity_tracks"),
        (F.sum("sc") / F.sum("n")).alias("mean_completeness_tracks"),
        F.avg("p").alias("mean_purity_events"),
        sem("p").alias("sem_purity_events"),
        F.avg("c").alias("mean_completeness_events"),
        sem("c").alias("sem_completeness_events"),
    )


def mean_and_spread(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean and sample deviation per column; a single value has spread 0."""
    spread = lambda c: F.when(F.count(c) == 1, F.lit(0.0)).otherwise(F.stddev_samp(c))
    return df.groupBy(*by).agg(
        *[F.avg(c).alias(f"{c}_mean") for c in columns], *[spread(c).alias(f"{c}_std") for c in columns]
    )


# --- seeds ------------------------------------------------------------------------------

TRIPLET = ("bX", "bY", "bZ", "mX", "mY", "mZ", "tX", "tY", "tZ")
MIDDLE = ("mX", "mY", "mZ")


def rounded_key(columns: Sequence[str], digits: int = 3) -> Column:
    return F.struct(*[F.round(F.col(c).cast("double"), digits).alias(c) for c in columns])


def filter_seeds(seeds: DataFrame, min_pt: float, per_middle: int) -> DataFrame:
    """Seeds above a pT cut, the best ``per_middle`` by quality at each middle point.

    ``seed_id`` (file order) breaks ties; without a quality column only pT cuts.
    """
    kept = seeds.where(F.col("pT") >= min_pt)
    if "quality" not in seeds.columns:
        return kept
    k = kept.withColumn("_mid", rounded_key(MIDDLE))
    return first_n(k, ["event_id", "_mid"], [F.col("quality").desc(), F.col("seed_id")], per_middle).drop("_mid")


def seed_recovery(
    tight: DataFrame, envelope: DataFrame, min_pt: float, per_middle: int, need: float = 0.98
) -> DataFrame:
    """Per event: how many distinct tight triplets occur in the envelope and in its filtered part."""
    def keys(df: DataFrame, flag: str) -> DataFrame:
        return df.select("event_id", rounded_key(TRIPLET).alias("_k")).distinct().withColumn(flag, F.lit(True))

    cut = filter_seeds(envelope, min_pt, per_middle)
    j = (
        keys(tight, "_t")
        .join(keys(envelope, "_e"), ["event_id", "_k"], "full_outer")
        .join(keys(cut, "_f"), ["event_id", "_k"], "left")
    )
    t, e, f = true("_t"), true("_e"), true("_f")
    g = j.groupBy("event_id").agg(
        count_if(t).alias("n_tight"),
        count_if(e).alias("n_envelope"),
        count_if(f).alias("n_filtered"),
        count_if(t & e).alias("n_tight_in_envelope"),
        count_if(t & f).alias("n_recovered"),
    )
    g = g.withColumns(
        {
            "frac_in_envelope": ratio("n_tight_in_envelope", "n_tight"),
            "frac_recovered": ratio("n_recovered", "n_tight"),
        }
    )
    return g.withColumn("passed", F.coalesce(F.col("frac_recovered") >= need, F.lit(False)))


def recovery_verdict(per_event: DataFrame, need: float = 0.98) -> DataFrame:
    g = per_event.agg(
        F.count(F.lit(1)).alias("n_events"),
        count_if(F.col("passed")).alias("n_passed"),
        F.avg("frac_recovered").alias("mean_recovered"),
    )
    return g.withColumn("passed", F.coalesce(F.col("mean_recovered") >= need, F.lit(False)))


# --- sweeps and comparisons -------------------------------------------------------------------


def compare_metrics(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two (metric, value) tables side by side with their difference."""
    a = left.select("metric", F.col("value").alias("left_value"))
    b = right.select("metric", F.col("value").alias("right_value"))
    return a.join(b, ["metric"], "full_outer").withColumn("delta", F.col("right_value") - F.col("left_value"))


def sweep_rows(runs: DataFrame, timing: DataFrame) -> DataFrame:
    """One row per sweep point: percentages, call counts, time shares and runtime per event.

    ``timing`` has one row per run and event in nanoseconds.
    """
    parts = ("gate_inference_ns", "gate_feature_ns", "value_inference_ns", "meas_selection_ns")
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0.0)))
    t = timing.groupBy("run_id").agg(
        F.sum(F.coalesce("gate_inference_calls", F.lit(0))).alias("gate_calls"),
        F.sum(F.coalesce("value_inference_calls", F.lit(0))).alias("value_calls"),
        *[total(c).alias(c) for c in parts],
        F.count(F.lit(1)).alias("_n"),
    )
    j = runs.join(t, ["run_id"], "left")
    spent = sum((F.col(c) for c in parts[1:]), F.col(parts[0]))
    pct = lambda c: F.round(F.col(c) * 100, 4)
    return j.select(
        "run_id",
        pct("efficiency").alias("efficiency"),
        pct("fake_rate").alias("fake_rate"),
        pct("duplicate_rate").alias("duplicate_rate"),
        F.coalesce("gate_calls", F.lit(0)).alias("gate_calls"),
        F.coalesce("value_calls", F.lit(0)).alias("value_calls"),
        F.when(spent > 0, F.col("gate_inference_ns") / spent).alias("gate_time_frac"),
        F.when(spent > 0, F.col("value_inference_ns") / spent).alias("value_time_frac"),
        ratio("wall_seconds", F.coalesce("events", "_n")).alias("runtime_per_event_s"),
        "wall_seconds",
    )


def join_diagnosis(
    cand: DataFrame,
    accepted: DataFrame,
    keys=("event_id", "seed_id", "geometry_id"),
    tolerances: Sequence[float] = (1e-4, 1e-3, 1e-2, 1e-1),
) -> DataFrame:
    """Why do candidates and accepted states not meet: keys, sign or tolerance? (one row)

    Both sides are reduced to the residual values per key before they meet.
    """
    ck, ak = cand.select(*keys).distinct(), accepted.select(*keys).distinct()
    overlap = ck.join(ak, list(keys), "inner").agg(F.count(F.lit(1)).alias("n_overlap"))
    sizes = beside(
        ck.agg(F.count(F.lit(1)).alias("n_cand_states")), ak.agg(F.count(F.lit(1)).alias("n_accepted_states"))
    )
    best = nearest_residuals(cand, accepted, keys)
    fracs = [
        F.avg((F.col(c) <= t).cast("double")).alias(f"{n}_within_{t:g}")
        for n, c in (("same_sign", "d_minus"), ("opposite_sign", "d_plus"))
        for t in tolerances
    ]
    return beside(beside(sizes, overlap), best.agg(*fracs))


def nearest_residuals(cand: DataFrame, accepted: DataFrame, keys) -> DataFrame:
    """Per key the smallest |r − a| and |r + a| over candidates r and accepted values a."""
    minus = nearest_value(cand, "residual_l0", accepted, "res_l0", keys, "d_minus")
    plus = nearest_value(cand, "residual_l0", accepted.withColumn("res_l0", -F.col("res_l0")), "res_l0", keys, "d_plus")
    return minus.join(plus, list(keys), "inner")


def nearest_value(left: DataFrame, x: str, right: DataFrame, y: str, keys: Sequence[str], out: str, buckets: int | None = None) -> DataFrame:
    """Per key the least distance between the values ``x`` of ``left`` and ``y`` of ``right`` (an as-of join both ways).

    With both sides of a key in one order, the nearest value is the last one before or the first one after, so no
    pairs are formed. The order is cut into range buckets inside each key, so that a hot key is many tasks; values
    of other buckets come from a table with one row per key and bucket. Missing and non-finite values are left out.
    """
    keys = list(keys)

    def side(df: DataFrame, value: str, tag: int) -> DataFrame:
        return df.where(finite(value)).select(*keys, F.col(value).cast("double").alias("_x"), F.lit(tag).alias("_tag")).distinct()

    both = cut_lineage(side(left, x, 0).unionByName(side(right, y, 1)), "asof")
    b = with_bucket(both, "_x", range_boundaries(both, "_x", buckets or bucket_count(both)))
    there = F.when(F.col("_tag") == 1, F.col("_x"))
    ends = b.groupBy(*keys, "_bucket").agg(F.min(there).alias("_lo"), F.max(there).alias("_hi"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(F.col("_bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    edges = ends.select(*keys, "_bucket", F.max("_hi").over(earlier).alias("_below"), F.min("_lo").over(later).alias("_above"))
    back = Window.partitionBy(*keys, "_bucket").orderBy("_x", "_tag").rowsBetween(Window.unboundedPreceding, -1)
    # The rows after, in reverse: a frame that grows from its end would be read anew for each row.
    ahead = Window.partitionBy(*keys, "_bucket").orderBy(F.col("_x").desc(), F.col("_tag").desc()).rowsBetween(Window.unboundedPreceding, -1)
    inside = b.withColumns({"_before": F.last(there, ignorenulls=True).over(back), "_after": F.last(there, ignorenulls=True).over(ahead)})
    j = inside.where("_tag = 0").join(edges, [*keys, "_bucket"])
    near = F.least(F.col("_x") - F.coalesce("_before", "_below"), F.coalesce("_after", "_above") - F.col("_x"))
    return j.withColumn("_d", near).where(F.col("_d").isNotNull()).groupBy(*keys).agg(F.min("_d").alias(out))


def key_overlap(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys on each side, shared and on one side only, with the shared fractions."""
    a = left.select(*keys).distinct().withColumn("_l", F.lit(True))
    b = right.select(*keys).distinct().withColumn("_r", F.lit(True))
    j = a.join(b, list(keys), "full_outer")
    l, r = true("_l"), true("_r")
    g = j.agg(
        count_if(l).alias("n_left"),
        count_if(r).alias("n_right"),
        count_if(l & r).alias("n_shared"),
        count_if(l & ~r).alias("n_left_only"),
        count_if(~l & r).alias("n_right_only"),
    )
    return g.withColumns(
        {"left_fraction": ratio("n_shared", "n_left"), "right_fraction": ratio("n_shared", "n_right")}
    )


def cleanest_track(tracks: DataFrame) -> DataFrame:
    """Per event the matched track with highest purity, then completeness, then hits, then lowest id."""
    order = F.struct(
        (-F.col("purity")).alias("p"), (-F.col("completeness")).alias("c"), (-F.col("n_meas")).alias("n"), F.col("track_nr")
    )
    return tracks.groupBy("event_id").agg(F.min_by("track_nr", order).alias("track_nr"))


