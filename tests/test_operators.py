"""Hand-computed answers on small frames; ids collide between two events."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark.functions import features, geometry, ids, stats
from trackspark.functions.strata import sensor_class
from trackspark.operators import calibration, expand, failure, matching, pareto, platt, quality, sampling, scoring, targets, truth

CAND = """event_id long, seed_id long, branch_id long, step_k long, cand_hit_id long, is_ckf_selected boolean,
          contrib_pids array<long>, branch_majority_pid long, majority_undefined boolean, chi2_inc double, volume_id long"""


def cand(spark, data, events=(0, 1)):
    full = [(ev, *row) for ev in events for row in data]
    return spark.createDataFrame(full, CAND)


def test_surface_ids_keep_all_bits(spark):
    gid = (28 << 56) | (14 << 36) | (301 << 8) | 3
    df = spark.createDataFrame([(gid,)], "g long")
    r = df.select(*ids.decode_surface("g"), ids.clear_ring("g").alias("c")).first()
    assert (r.volume_id, r.layer_id, r.module_id, r.c) == (28, 14, 301, gid - 3)
    e = df.select(ids.encode_surface(F.lit(28), F.lit(14), F.lit(301)).alias("e")).first().e
    assert e == gid - 3


def test_cholesky_eta_and_degenerate_chi2(spark):
    df = spark.createDataFrame([(4.0, 2.0, 5.0, math.pi / 2)], "a double, b double, c double, t double")
    chol = geometry.cholesky_2x2("a", "b", "c")
    r = df.select(*[v.alias(k) for k, v in chol.items()], geometry.pseudorapidity("t").alias("eta")).first()
    assert (r.chol_S_00, r.chol_S_10, r.chol_S_11) == pytest.approx((2.0, 1.0, 2.0))
    assert r.eta == pytest.approx(0.0, abs=1e-12)
    bad = spark.createDataFrame([(1.0, 2.0, 1.0, 5.0, 1.0)], "r0 double, r1 double, a double, b double, c double")
    x = geometry.chi2_increment("r0", "r1", "a", "b", "c", F.lit(False))
    assert bad.select(x.alias("x")).first().x == pytest.approx(5.0)


def test_nan_is_no_window_hit(spark):
    df = spark.createDataFrame([(1.0, float("nan"))], "r double, s double")
    clean = df.select(F.col("r"), F.when(~F.isnan("s"), F.col("s")).alias("s"))
    assert clean.select(geometry.in_box("r", "r", "s", "s", F.lit(False), 3).alias("b")).first().b is False


def test_sensor_classes(spark):
    df = spark.createDataFrame([(17,), (24,), (29,), (20,)], "v long")
    assert [r.s for r in df.select(sensor_class("v").alias("s")).collect()] == [0, 1, 2, -1]


def test_feature_selection_refuses_unknown_names():
    names = features.GATE_FEATURES
    assert len(names) == 26
    rows = features.feature_rows()
    assert features.select_features(rows, without=["eta"]) == [n for n in names if n != "eta"]
    for bad in (dict(without=["nope"]), dict(groups=["nope"]), dict(without=names)):
        with pytest.raises(ValueError):
            features.select_features(rows, **bad)
    with pytest.raises(ValueError, match="no group 'a'; no feature 'b'"):
        features.select_features(rows, groups=["a"], without=["b"])


# --- expansion -----------------------------------------------------------------------------

STATES = """event_id long, track_nr long, state_idx long, geometry_id long, is_predicted boolean, pred_l0 double,
            pred_l1 double, S00 double, S01 double, S11 double, sel_l0 double, sel_l1 double"""
MEAS = "event_id long, measurement_id long, geometry_id long, local0 double, local1 double, var_local0 double, var_local1 double"


def _expand(spark, states, meas, **kw):
    s = spark.createDataFrame([(ev, *r) for ev in (0, 1) for r in states], STATES)
    m = spark.createDataFrame([(ev, *r) for ev in (0, 1) for r in meas], MEAS)
    return expand.expand_states(s, m, n=3.0, **kw)


def test_expansion_holes_selection_and_strips(spark, rows):
    states = [
        (1, 0, 10, True, 0.0, 0.0, 1.0, 0.0, 1.0, 0.5, 0.5),
        (1, 1, 11, True, 0.0, 0.0, 1.0, 0.0, 1.0, 2.0, 7.0),
        (1, 2, 12, True, 0.0, 0.0, 1.0, 0.0, 1.0, None, None),
        (1, 3, 13, True, 0.0, 0.0, 1.0, 0.0, 1.0, None, None),
        (1, 4, 10, True, None, 0.0, 1.0, 0.0, 1.0, None, None),
    ]
    meas = [
        (5, 10, 0.5, 0.5, 0.1, 0.1),
        (4, 10, 0.5, 0.5, 0.1, 0.1),
        (6, 10, 2.0, 2.0, 0.1, 0.1),
        (7, 11, 2.0, 99.0, 0.1, 0.0),
        (8, 12, 50.0, 0.0, 0.1, 0.1),
    ]
    e = _expand(spark, states, meas)
    got = rows(e.candidates, "event_id", "state_idx", "cand_hit_id", "n_window", "is_ckf_selected", "action_taken", "is_1d")
    one = [
        (0, 4, 3, True, 0, False),
        (0, 5, 3, False, 0, False),
        (0, 6, 3, False, 0, False),
        (1, 7, 1, True, 0, True),
        (2, -1, 0, False, 2, False),
        (3, -1, 0, False, 1, False),
    ]
    assert got == [(ev, *r) for ev in (0, 1) for r in one]
    rep = expand.selection_report(e).first()
    assert (rep.n_accepted, rep.n_matched) == (4, 4)


def test_guard_counts_states_without_candidates(spark):
    states = [(1, i, 10 + i, True, 0.0, 0.0, 1.0, 0.0, 1.0, 0.0, 0.0) for i in range(3)]
    meas = [(5, 10, 0.0, 0.0, 0.1, 0.1)]
    with pytest.raises(expand.WriteRefused):
        expand.require_selection(_expand(spark, states, meas))


def test_hot_surface_pairs_equal_brute_force(spark):
    r = random.Random(5)
    meas = [(i, 1, r.uniform(-50, 50), r.uniform(-1, 1), 0.01, r.choice([0.0, 0.01])) for i in range(800)]
    states = [(1, i, 1, True, r.uniform(-50, 50), 0.0, r.choice([1e-4, 0.01, 4.0]), 0.0, 0.04, None, None) for i in range(300)]
    e = _expand(spark, states, meas, radius=0.3)
    got = {(x.state_idx, x.cand_hit_id) for x in e.candidates.where("event_id = 1 AND cand_hit_id >= 0").collect()}
    want = set()
    for st in states:
        for m in meas:
            r0, r1 = m[2] - st[4], m[3] - st[5]
            if abs(r0) <= 3 * math.sqrt(st[6]) and (m[5] <= 0 or abs(r1) <= 3 * math.sqrt(st[8])):
                want.add((st[1], m[0]))
    assert got == want
    near = {x.state_idx: x.geometric_density for x in e.states.where("event_id = 0").collect()}
    for st in states:
        n = sum(math.hypot(m[2] - st[4], 0.0 if m[5] <= 0 else m[3] - st[5]) <= 0.3 for m in meas)
        assert near[st[1]] == n


def test_history_counts_before_the_state(spark, rows):
    hits = [1, 0, 0, 2, 0]
    df = spark.createDataFrame([(ev, 3, i, n) for ev in (0, 1) for i, n in enumerate(hits)], "event_id long, track_nr long, state_idx long, n_window long")
    for width in (65536, 2):
        got = rows(expand.branch_history(df, width=width).where("event_id = 0"), "state_idx", "n_hits", "n_holes", "n_seq_holes")
        assert got == [(0, 0, 0, 0), (1, 1, 0, 0), (2, 1, 1, 1), (3, 1, 2, 2), (4, 2, 2, 0)]


def test_majority_needs_three_states_and_two_votes(spark, rows):
    data = [(0, 1, i, p, 1) for i, p in enumerate([7, 9, 9, 7, 7])]
    data += [(0, 2, i, p, 1) for i, p in enumerate([1, 2, 3])] + [(0, 3, 0, 5, 1), (0, 3, 1, 5, 1)]
    df = spark.createDataFrame(data, "event_id long, track_nr long, state_idx long, state_primary_pid long, state_n_contribs int")
    got = rows(truth.branch_majority(df), "track_nr", "branch_majority_pid", "majority_undefined")
    assert got == [(1, 9, False), (2, -1, True), (3, -1, True)]


# --- targets --------------------------------------------------------------------------------


def test_logged_target_by_hand(spark, rows):
    flags = [(1, 0, True), (0, 1, False), (0, 0, True), (1, 0, True)]
    steps = spark.createDataFrame(
        [(ev, 1, 1, k, c, w, m, 42) for ev in (0, 1) for k, (c, w, m) in enumerate(flags)],
        "event_id long, seed_id long, branch_id long, step_k long, sel_correct int, sel_wrong int, maj_hit_on_surface boolean, branch_majority_pid long",
    )
    totals = spark.createDataFrame([(0, 42, 4)], "event_id long, particle_id long, n_total long")
    for width in (65536, 2):
        t = targets.logged_targets(steps, totals, width=width)
        got = rows(t.where("event_id = 0"), "step_k", "n_correct", "n_wrong", "n_findable_t2", "vstar_t2")
        assert got == [(0, 1, 0, 2, 0.75), (1, 1, 1, 2, 0.75), (2, 1, 1, 1, 0.5), (3, 2, 1, 0, 0.5)]
        # The same particle id has no total in the other event.
        assert t.where("event_id = 1 AND vstar_t2 IS NOT NULL").isEmpty()


def test_surface_revisits_are_flagged(spark):
    steps = spark.createDataFrame(
        [(0, 1, 1, k, 0, 0, True, 42) for k in range(6)],
        "event_id long, seed_id long, branch_id long, step_k long, sel_correct int, sel_wrong int, maj_hit_on_surface boolean, branch_majority_pid long",
    )
    totals = spark.createDataFrame([(0, 42, 3)], "event_id long, particle_id long, n_total long")
    t = targets.logged_targets(steps, totals)
    assert not t.where("tier_invariant_violated").isEmpty()
    assert targets.valid_targets(t).where("tier_invariant_violated").isEmpty()


def _rollout(spark, states, futures, past, totals, width=65536, open_ends=False):
    s = spark.createDataFrame([(0, *x) for x in states], "event_id long, seed_id long, step_k long, state_class string, sel_hit long")
    f = spark.createDataFrame([(0, *x) for x in futures], "event_id long, seed_id long, step_k long, n_findable long")
    p = spark.createDataFrame([(0, *x) for x in past], "event_id long, seed_id long, step_k long, n_correct long, n_wrong long")
    n = spark.createDataFrame([(0, *x) for x in totals], "event_id long, seed_id long, n_total long")
    return targets.rollout_targets(s, f, p, n, width=width, open_ends=open_ends)


def test_rollout_targets_by_hand(spark, rows):
    states = [(1, k, "tip" if k == 9 else "collapse", 50 + k) for k in range(10)]
    past = [(1, k, k + 1, 0) for k in range(10)]
    for width in (65536, 4):
        out, rep = _rollout(spark, states, [(1, 9, 0)], past, [(1, 10)], width)
        assert [v for _, v in rows(out, "step_k", "vstar_rollout")] == [1.0] * 10
        assert rep.isEmpty()
    # Nine correct hits, then a wrong tip on a ten-hit particle.
    states = [(1, k, "collapse", 50 + k) for k in range(8)] + [(1, 8, "divergence", 58), (1, 9, "tip", 99)]
    past = [(1, k, min(k + 1, 9), 1 if k == 9 else 0) for k in range(10)]
    out, _ = _rollout(spark, states, [(1, 8, 1), (1, 9, 0)], past, [(1, 10)])
    got = [v for _, v in rows(out, "step_k", "vstar_rollout")]
    assert got == [1.0] * 9 + [0.9]


def test_rollout_refuses_branches_without_a_tip(spark, rows):
    args = ([(1, 0, "collapse", 5)], [(1, 0, 1)], [(1, 0, 1, 0)], [(1, 2)])
    with pytest.raises(ValueError, match="without a tip"):
        _rollout(spark, *args)
    out, rep = _rollout(spark, *args, open_ends=True)
    assert out.isEmpty() and rows(rep, "reason", "n_branches") == [("last_state_not_tip", 1)]


def test_rollout_target_drops_whole_branches(spark, rows):
    states = [(s, k, "tip" if k == 1 else "collapse", 5) for s in (1, 2, 3) for k in range(2)]
    past = [(s, k, k + 1, 0) for s in (1, 2, 3) for k in range(2) if (s, k) != (3, 0)]
    out, rep = _rollout(spark, states, [(2, 1, 0), (3, 1, 0)], past, [(1, 2), (3, 2)])
    assert out.isEmpty()
    assert rows(rep, "reason", "n_branches") == [("missing_past", 1), ("missing_rollout", 1), ("missing_total", 1)]


def test_truth_pick_rules_agree(spark, rows):
    data = [
        (1, 1, 0, 12, True, [3], 3, False, 2.0, 17),
        (1, 1, 0, 11, False, [3, 4], 3, False, 2.0, 17),
        (1, 1, 0, 10, False, [4], 3, False, 0.1, 17),
        (1, 1, 1, 11, True, [3], 3, False, 1.0, 17),
        (1, 1, 2, -1, False, None, 3, False, None, 17),
    ]
    df = cand(spark, data)
    assert rows(targets.truth_pick(df).where("event_id = 0"), "step_k", "truth_pick") == [(0, 11), (1, 11)]
    got = rows(targets.classify_states(df).where("event_id = 1"), "step_k", "sel_hit", "truth_pick", "state_class")
    assert got == [(0, 12, 11, "collapse"), (1, 11, 11, "collapse"), (2, -1, -1, "tip")]


# --- purity, emulation -----------------------------------------------------------------------------


def test_the_two_purity_rules_differ_on_short_branches(spark, rows):
    data = [(1, 1, k, 10 + k, True, [3], 3, False, 1.0, 17) for k in range(2)]
    df = cand(spark, data)
    assert rows(failure.seed_purity(df), "event_id", "seed_purity") == [(0, "majority"), (1, "majority")]
    chosen = failure.followed_branch(df)
    assert rows(failure.branch_purity(df, chosen), "event_id", "is_pure") == [(0, True), (1, True)]


def test_followed_branch_breaks_ties_low(spark, rows):
    data = [(1, b, k, 10 + k, True, [3], 3, False, 1.0, 17) for b, n in ((7, 2), (5, 2), (9, 1)) for k in range(n)]
    assert rows(failure.followed_branch(cand(spark, data)), "event_id", "branch_id") == [(0, 5), (1, 5)]


def test_emulation_cuts_at_the_hole_limit(spark, rows):
    point = failure.OperatingPoint(chi2_max=10.0, min_hits=3, max_holes=1, pt_min=0.5)

    def branch(seed, pattern, qop=1.0, vol=17):
        st, cd = [], []
        for k, c in enumerate(pattern):
            st.append((0, seed, k, math.pi / 2, 20 if c == "p" else vol, qop))
            if c == "h":
                cd.append((seed, seed, k, 100 + k, True, [1], 1, False, 1.0, vol))
        return st, cd

    cases = {1: branch(1, "hhhoo"), 2: branch(2, "oohhh"), 3: branch(3, "hpphphpo"), 4: branch(4, "hhhh", qop=0.0)}
    st = spark.createDataFrame([r for s, _ in cases.values() for r in s], "event_id long, seed_id long, step_k long, state_theta double, volume_id long, state_qop double")
    cd = cand(spark, [r for _, c in cases.values() for r in c], events=(0,))
    for width in (65536, 2):
        got = rows(failure.emulate(cd, st, point, width=width), "seed_id", "passes_emulation", "cutoff_step")
        assert got == [(1, True, 4), (2, False, 1), (3, True, None), (4, False, None)]


def test_cube_slices_only_at_edges(spark):
    df = spark.createDataFrame([(0, 0, True, 0, 1, True, 5)], "eta_bin int, sensor int, is_pure boolean, occupancy int, pt_bin int, survived boolean, mod_total long")
    assert failure.slice_cube(df, ["sensor"], pt_min=0.7).first().mod_total == 5
    assert failure.slice_cube(df, ["sensor"], pt_min=0.9).isEmpty()
    with pytest.raises(ValueError):
        failure.slice_cube(df, ["sensor"], pt_min=0.8)


# --- calibration --------------------------------------------------------------------------------------


def _scores(spark, n=4000, seed=2):
    rng = np.random.default_rng(seed)
    z = rng.normal(0, 2, n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.7 * z - 0.4)))).astype(int)
    w = rng.integers(1, 9, n)
    rows_ = [(int(i), float(a), float(1 / (1 + math.exp(-a))), int(b), int(c)) for i, (a, b, c) in enumerate(zip(z, y, w))]
    return z, y, spark.createDataFrame(rows_, "row_id long, logit double, prob double, label int, n_window long")


def test_every_row_lands_in_a_bin_and_ece_is_zero_when_perfect(spark):
    _, _, df = _scores(spark)
    t = calibration.reliability(df, "prob", "label")
    assert t.agg(F.sum("count")).first()[0] == 4000
    assert t.count() == 30
    bad = t.where("NOT (ci_lower <= observed_fraction AND observed_fraction <= ci_upper) AND count > 0")
    assert bad.isEmpty()
    perfect = spark.createDataFrame([(0.5, 1), (0.5, 0)] * 200, "prob double, label int")
    assert calibration.calibration_errors(perfect, "prob", "label").first().ece == 0.0


def test_ranking_against_pairs_and_monotone_maps(spark):
    z, y, df = _scores(spark, 400)
    df = df.withColumn("s", F.round("logit", 1))
    s = np.round(z, 1)
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :]))
    got = calibration.ranking_metrics(df, "s", "label").first()
    assert got.auc_roc == pytest.approx(auc, abs=1e-9)
    ap, tp, seen = 0.0, 0, 0
    for v in sorted(set(s.tolist()), reverse=True):
        k, m = int(((s == v) & (y == 1)).sum()), int((s == v).sum())
        tp, seen = tp + k, seen + m
        ap += k / len(pos) * tp / seen
    assert got.auc_pr == pytest.approx(ap, abs=1e-9)
    mapped = df.withColumn("s2", stats.platt("s", 1.7, -0.3))
    assert calibration.ranking_metrics(mapped, "s2", "label").first().auc_roc == pytest.approx(auc, abs=1e-9)
    single = df.where("label = 1")
    assert calibration.ranking_metrics(single, "s", "label").first().auc_roc is None


def test_platt_recovers_parameters_and_refuses_one_class(spark):
    _, _, df = _scores(spark, 6000)
    fit = platt.fit_platt(df, "logit", "label")
    assert fit.params == pytest.approx((0.7, -0.4), abs=0.12)
    assert fit.trace[-1] <= fit.trace[0]
    with pytest.raises(ValueError):
        platt.fit_platt(df.where("label = 1"), "logit", "label")


def test_rebinning_is_exact_and_refuses_uneven_splits(spark):
    _, _, df = _scores(spark)
    h = calibration.probability_histogram(df, "prob", "label")
    r = calibration.rebin(h, 1000, 20)
    assert r.agg(F.sum("count")).first()[0] == 4000
    with pytest.raises(ValueError):
        calibration.rebin(h, 1000, 7)


def test_grid_closes_its_last_bin(spark):
    df = spark.createDataFrame([(25.0, 1), (-25.0, 0), (0.0, 1)], "z double, y int")
    got = {r.edge: (r.tp, r.fp) for r in calibration.grid_curves(df, "z", "y", n=40).collect()}
    assert got[0] == (2, 1) and got[20] == (2, 0) and got[21] == (1, 0) and got[40] == (0, 0)


def test_window_filter_refuses_absent_values(spark):
    df = spark.createDataFrame([(7.0,)], "window_nsigma double")
    assert calibration.window_filter(df, 7.0).count() == 1
    with pytest.raises(ValueError):
        calibration.window_filter(df, 5.0)
    with pytest.raises(ValueError):
        calibration.window_filter(df.drop("window_nsigma"), 5.0)


# --- sampling -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("partitions", [1, 8])
def test_samples_keep_positives_and_exact_counts(spark, partitions):
    data = [(i, 1 if i % 20 == 0 else 0, None if i % 7 == 0 else 0.1 * (i % 50)) for i in range(2000)]
    df = spark.createDataFrame(data, "row_id long, y int, chi2 double").repartition(partitions)
    for d in (
        sampling.uniform_subsample(df, "y", "row_id", 5, seed=3),
        sampling.weighted_subsample(df, "y", "row_id", sampling.hard_weight("chi2"), 5, seed=3),
    ):
        got = [(r.row_id, r.y) for r in d.collect()]
        assert sorted(i for i, y in got if y == 1) == list(range(0, 2000, 20))
        assert sum(y == 0 for _, y in got) == 500


def test_weighted_draws_follow_the_weights(spark):
    # One negative carries a third of all weight; half of the negatives weigh next to nothing.
    w = [50.0] + [1.0] * 100 + [1e-9] * 400
    data = [(i, 0, x) for i, x in enumerate(w)] + [(1000 + i, 1, 0.0) for i in range(3000)]
    df = spark.createDataFrame(data, "row_id long, y int, w double")
    d = sampling.weighted_subsample(df, "y", "row_id", F.col("w"), 5, seed=11).where("y = 0")
    counts = {r.row_id: r["count"] for r in d.groupBy("row_id").count().collect()}
    n = sum(counts.values())
    assert n == 15000
    assert counts[0] / n == pytest.approx(50 / 150, abs=0.015)
    each = [counts.get(i, 0) for i in range(1, 101)]
    assert min(each) > 60 and max(each) < 145
    assert sum(counts.get(i, 0) for i in range(101, 501)) == 0


@pytest.mark.parametrize("buckets", ["4", "7"])
def test_weighted_draws_match_interval_lookup(spark, buckets):
    data = [(i, 1 if i >= 900 else 0, float(1 + i % 13)) for i in range(1000)]
    df = spark.createDataFrame(data, "row_id long, y int, w double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", buckets)
    try:
        d = sampling.weighted_subsample(df, "y", "row_id", F.col("w"), 3, seed=5).where("y = 0")
        got = {r.row_id: r["count"] for r in d.groupBy("row_id").count().collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    keys = spark.createDataFrame([(i, k) for i in range(900, 1000) for k in (1, 2, 3)], "p long, r int")
    us = [r.u for r in keys.select(sampling.uniform_hash(5, "p", "r").alias("u")).collect()]
    w = np.array([x[2] for x in data if x[1] == 0])
    edges = np.cumsum(w) / w.sum()
    want = {}
    for u in us:
        i = int(np.searchsorted(edges, u, side="right"))
        want[i] = want.get(i, 0) + 1
    assert got == want


def test_partial_tables_are_refused(spark):
    sampling.refuse_partial(spark.createDataFrame([(False,)], "is_partial boolean"))
    with pytest.raises(ValueError):
        sampling.refuse_partial(spark.createDataFrame([(True,)], "is_partial boolean"))


# --- matching, Pareto, scoring ----------------------------------------------------------------------------


@pytest.mark.parametrize("k", [2, 3])
def test_pareto_front_against_brute_force(spark, k):
    r = random.Random(k)
    pts = [(i, *[None if r.random() < 0.02 else r.randint(0, 12) / 2 for _ in range(k)]) for i in range(300)]
    cols = [f"c{i}" for i in range(k)]
    df = spark.createDataFrame([(p[0], *[None if v is None else float(v) for v in p[1:]]) for p in pts], "id long, " + ", ".join(f"{c} double" for c in cols)).repartition(6)
    sign = [1] + [-1] * (k - 1)
    full = [p for p in pts if None not in p]

    def dom(a, b):
        x = [s * v for s, v in zip(sign, a[1:])]
        y = [s * v for s, v in zip(sign, b[1:])]
        return all(i >= j for i, j in zip(x, y)) and x != y

    want = {p[0] for p in full if not any(dom(o, p) for o in full)}
    got = {x.id for x in pareto.pareto_front(df, [("c0", "max")] + [(c, "min") for c in cols[1:]]).collect()}
    assert got == want


def test_pareto_blocks_give_the_same_front(spark, monkeypatch):
    r = random.Random(9)
    df = spark.createDataFrame([(i, r.random(), r.random(), r.random()) for i in range(400)], "id long, a double, b double, c double")
    obj = [("a", "min"), ("b", "min"), ("c", "min")]
    whole = {x.id for x in pareto.pareto_front(df, obj).collect()}
    monkeypatch.setattr(pareto, "bucket_count", lambda df: 3)
    assert {x.id for x in pareto.pareto_front(df, obj).collect()} == whole


def test_seed_filter_keeps_the_best_per_middle_point(spark, rows):
    cols = ", ".join(f"{p}{a} double" for p in "bmt" for a in "XYZ")
    data = [(0, i, 1.0, float(q), *([0.0] * 3), 1.0, 1.0, 1.0, *([float(i)] * 3)) for i, q in enumerate([3, 9, 9, 1])]
    df = spark.createDataFrame(data, f"event_id long, seed_id long, pT double, quality double, {cols}")
    assert rows(matching.filter_seeds(df, 0.5, 2), "seed_id") == [(1,), (2,)]
    assert matching.filter_seeds(df, 2.0, 2).isEmpty()
    v = matching.recovery_verdict(matching.seed_recovery(df, df, 0.5, 2)).first()
    assert v.mean_recovered == 0.5 and v.passed is False


def test_mlp_matches_numpy(spark):
    rng = np.random.default_rng(0)
    model = scoring.Mlp(("a", "b"), (0.5, 0.0), (2.0, 1.0), (rng.normal(size=(3, 2)), rng.normal(size=(1, 3))), (rng.normal(size=3), np.array([0.1])))
    df = spark.createDataFrame([(float(i), float(i % 3)) for i in range(50)], "a double, b double").repartition(5)
    for row in scoring.score(df, model).collect():
        x = np.array([(row.a - 0.5) / 2.0, row.b])
        h = model.weights[0] @ x + model.biases[0]
        h = h / (1 + np.exp(-h))
        assert row.logit == pytest.approx(float((model.weights[1] @ h + model.biases[1])[0]))


def test_gate_selection_and_causes(spark, rows):
    data = [(1, 1, 0, 5, False, [1], 1, False, 1.0, 17), (1, 1, 0, 6, False, [1], 1, False, 2.0, 17), (1, 1, 0, 7, False, [1], 1, False, 3.0, 17),
            (1, 1, 1, 8, False, [1], 1, False, 9.0, 17), (1, 1, 2, -1, False, None, 1, False, None, 17)]
    df = cand(spark, data, events=(0,)).withColumn("s", F.lit(1.0) / F.col("chi2_inc"))
    assert rows(scoring.select_candidates(df, "s", 0.3, 2), "step_k", "cand_hit_id") == [(0, 5), (0, 6)]
    got = rows(scoring.selection_outcome(df, "s", 0.3), "step_k", "n_passed", "hole_cause")
    assert got == [(0, 3, None), (1, 0, "gate_failure"), (2, 0, "no_measurements")]
    tight = scoring.selection_outcome(df, "s", 0.3, in_window=F.col("chi2_inc") < 5)
    assert rows(tight.where("step_k = 1"), "hole_cause") == [("window_failure",)]


def test_stop_decisions(spark, rows):
    data = [(0, s, s, k, k, 0.1 if k >= bad else 0.9) for s, bad in ((1, 0), (2, 7), (3, 99)) for k in range(9)]
    df = spark.createDataFrame(data, "event_id long, seed_id long, branch_id long, step_k long, n_hits long, p double")
    got = rows(scoring.stop_decision(df, "p", 0.5), "seed_id", "stop_step", "decision")
    assert got == [(1, 3, "stop_drop"), (2, 7, "stop_keep"), (3, None, "continue")]


# --- quality -------------------------------------------------------------------------------------------------


def test_orientation_rejects_source_order(spark):
    def frame(flip):
        return spark.createDataFrame(
            [(0, t, 3 - k if flip else k, float(10 * k)) for t in range(5) for k in range(4)],
            "event_id long, track_nr long, step_k long, path_length double",
        )

    quality.require_orientation(quality.orientation(frame(False)))
    with pytest.raises(ValueError):
        quality.require_orientation(quality.orientation(frame(True)))


def test_bootstrap_draws_as_many_events_as_there_are(spark):
    cells = spark.createDataFrame([(e, c, 0, 10, e % 4) for e in range(9) for c in (0, 1)], "event_id long, chi2_bin int, occ_bin int, n long, k long")
    m = failure.bootstrap_multiplicity(cells, 20)
    assert {r[0] for r in m.groupBy("boot").agg(F.sum("times")).select("sum(times)").collect()} == {9}
    bands = failure.bootstrap_bands(failure.bootstrap_fractions(cells, m)).collect()
    assert len(bands) == 2 and all(0 <= b.frac_lo <= b.frac_hi <= 1 for b in bands)


def test_nearest_values_of_a_hot_key_are_many_tasks(spark):
    r = random.Random(9)
    left = [(0, r.uniform(-50, 50)) for _ in range(4000)] + [(1, 5.0), (2, None), (3, 1.0), (None, 0.0)]
    right = [(0, r.uniform(-50, 50)) for _ in range(300)] + [(1, -7.0), (1, 5.5), (2, 1.0), (4, 0.0), (None, 0.0)]
    a, b = spark.createDataFrame(left, "k long, x double"), spark.createDataFrame(right, "k long, y double")
    found = matching.nearest_value(a, "x", b, "y", ["k"], "d", buckets=16)
    want = {k: min(abs(x - y) for j, x in left if j == k for i, y in right if i == k) for k in (0, 1)}
    got = {row.k: row.d for row in found.collect()}
    assert got == pytest.approx(want)
    # The windows run on the key and a bucket of its values.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" in plan and "_bucket" in plan
    assert matching.nearest_value(a.limit(0), "x", b, "y", ["k"], "d").count() == 0


def test_strata_are_rolled_up_from_one_pass(spark):
    r = random.Random(2)
    data = [(r.randrange(3), r.random() < 0.4, round(r.random(), 2), r.random() * 0.98 + 0.01) for _ in range(3000)]
    df = spark.createDataFrame([(g, int(y), p, q) for g, y, p, q in data], "g long, y int, p double, q double")
    strata = {"all": F.lit("all"), "group": F.when(F.col("g") > 0, F.col("g"))}
    got = {(b.estimator, b.family, b.stratum): b for b in calibration.stratified_bundles(df, ["p", "q"], strata, "y").collect()}
    assert set(got) == {(e, f, s) for e in "pq" for f, s in [("all", "all"), ("group", "1"), ("group", "2")]}
    for (e, f, s), b in got.items():
        part = df if f == "all" else df.where(F.col("g") == int(s))
        plain = calibration.metric_bundle(part, e, "y").first()
        for c in ("n_pos", "n_neg", "auc_roc", "auc_pr", "n_rows", "ece", "mce", "dr_n_rows", "dr_ece", "threshold_ece", "base_rate"):
            assert b[c] == pytest.approx(plain[c], abs=1e-12), (e, f, s, c)
