"""The window join against all pairs, on surfaces that are wide both ways, hot, or hold outliers."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from trackspark.checks import registry
from trackspark.operators import expand, window_counts
from trackspark.plans import expansion

STATES = "event_id long, track_nr long, state_idx long, geometry_id long, pred_l0 double, pred_l1 double, sel_l0 double, sel_l1 double, P00 double, P01 double, P11 double"
MEAS = "event_id long, geometry_id long, measurement_id long, local0 double, local1 double, var_local0 double, var_local1 double"
N, RADIUS = 3.0, 0.05


def case(n_states, n_meas, seed=1, flat=0.0):
    r = random.Random(seed)
    meas = [(0, 7, k, r.uniform(-100, 100), r.uniform(-100, 100), 0.01, -1.0 if r.random() < flat else 0.02) for k in range(n_meas)]
    # One measurement that says nothing, one without a variance, and one state that reaches everywhere.
    meas += [(0, 7, n_meas, 0.0, 0.0, 1e6, 1e6), (0, 7, n_meas + 1, 1.0, 2.0, 0.0, 0.02), (0, 9, n_meas + 2, 5.0, 5.0, 0.01, 0.02)]
    states = [(0, k, 0, 7, r.uniform(-100, 100), r.uniform(-100, 100), None, None, r.choice([0.01, 0.3, 2.0]), 0.0, r.choice([0.01, 0.4])) for k in range(n_states)]
    states += [(0, n_states, 0, 7, 3.0, 4.0, None, None, 1e5, 0.0, 1e5), (0, n_states + 1, 0, 7, 3.0, None, None, None, 0.5, 0.0, None), (0, n_states + 2, 0, 8, 0.0, 0.0, None, None, 1.0, 0.0, 1.0)]
    return states, meas


def plain(states, meas):
    out = set()
    for s in states:
        for m in meas:
            if s[3] != m[1]:
                continue
            flat = m[6] is None or m[6] <= 0
            r0 = m[3] - s[4]
            r1 = None if s[5] is None else m[4] - s[5]
            s00 = m[5] + s[8]
            s11 = None if flat or s[10] is None else m[6] + s[10]
            box = abs(r0) <= N * s00**0.5 and (flat or (r1 is not None and s11 is not None and abs(r1) <= N * s11**0.5))
            near = abs(r0) <= RADIUS if flat else r1 is not None and r0 * r0 + r1 * r1 <= RADIUS**2
            if box or near:
                out.add((s[1], m[2]))
    return out


@pytest.mark.parametrize("flat", [0.0, 0.5])
def test_pairs_match_all_pairs(spark, flat):
    states, meas = case(60, 400, flat=flat)
    got = expand.window_pairs(spark.createDataFrame(states, STATES), spark.createDataFrame(meas, MEAS), N, RADIUS)
    pairs = [(r.track_nr, r.cand_hit_id) for r in got.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == plain(states, meas)


def test_tested_pairs_stay_near_the_result(spark):
    states, meas = case(400, 4000, seed=2)
    s, m = spark.createDataFrame(states, STATES), spark.createDataFrame(meas, MEAS)
    tested, found = expand.meeting_pairs(s, m, N, RADIUS).count(), expand.window_pairs(s, m, N, RADIUS).count()
    assert tested <= 8 * found and tested < 0.05 * len(states) * len(meas)


USABLE = STATES.replace("P00", "S00").replace("P01", "S01").replace("P11", "S11") + ", is_predicted boolean"


@pytest.mark.parametrize("block", [16, 1 << 16])
def test_counts_without_pairs_match_the_pairs(spark, rows, monkeypatch, block):
    # Equal positions, one hot value, wide states, surfaces without measurements, accepted positions with ties.
    monkeypatch.setattr(window_counts, "BLOCK", block)
    monkeypatch.setattr(window_counts, "STATES", 4 * block)
    r = random.Random(5)
    meas = [(0, 7, k, r.choice([r.uniform(-10, 10), float(round(r.uniform(-10, 10))), 1.0]), r.uniform(-1, 1), 0.01, r.choice([0.0, 0.02])) for k in range(500)]
    meas += [(0, 7, 500, None, 0.0, 0.01, 0.02), (0, 7, 501, 1.0, None, 0.01, 0.02), (0, 7, 502, 1.0, None, 0.01, None), (0, 9, 503, 5.0, 5.0, 0.01, 0.02)]
    near = lambda x: r.choice([None, x, x + 0.5, float("nan")])
    states = []
    for k in range(200):
        x, y = r.choice([round(r.uniform(-10, 10)), r.uniform(-10, 10)]) * 1.0, r.choice([None, r.uniform(-1, 1)])
        states.append((0, k, 0, r.choice([7, 7, 7, 9, 8]), x, y, near(x), near(0.1), r.choice([0.01, 0.3, 1e4, -1.0]), 0.0, r.choice([0.01, 0.4, None]), True))
    s, m = spark.createDataFrame(states, USABLE), spark.createDataFrame(meas, MEAS)
    names = ("track_nr", "n_window", "_sel_id", "_had_meas")
    got = rows(expand.count_states(s, m, N, 0.6).states, *names)
    want = rows(expand.expand_states(s, m, N, RADIUS, 0.6).states, *names)
    assert got == want and sum(g[2] is not None for g in got) > 20


@pytest.mark.parametrize("built", [False, True])
def test_no_table_of_pairs_is_stored(spark, monkeypatch, built):
    # Every state meets every measurement; what is written must follow the rows.
    meas = [(0, 7, k, 0.001 * k, 0.0, 0.01, 0.02) for k in range(300)]
    states = [(0, k, 0, 7, 0.1, 0.0, 0.1, None, 1.0, 0.0, 1.0, True) for k in range(200)]
    stored = {}

    def kept(df, label="cut", cut=expand.cut_lineage):
        out = cut(df, label)
        stored[label] = out.count()
        return out

    monkeypatch.setattr(expand, "cut_lineage", kept)
    s = spark.createDataFrame(states, USABLE)
    predicted = s.selectExpr("event_id", "track_nr", "state_idx", "S00 AS P00", "S01 AS P01", "S11 AS P11") if built else None
    rows = expand.expand_states(s, spark.createDataFrame(meas, MEAS), N, RADIUS, 0.6, predicted).candidates
    assert rows.count() == len(states) * len(meas)
    assert rows.where("is_ckf_selected").select("cand_hit_id").distinct().collect() == [(100,)]
    assert stored and max(stored.values()) <= 2 * len(states)


def test_candidate_table_carries_what_belongs_to_measurements(spark, rows):
    meas = [(0, 7, k, 0.1 * k, 0.0, 0.01, 0.02) for k in range(6)]
    states = [(0, 1, 0, 7, 0.1, 0.0, 0.1, None, 0.01, 0.0, 1.0, True, 1, 1, 9.0), (0, 1, 1, 7, 99.0, 0.0, None, None, 0.01, 0.0, 1.0, True, 1, 1, 8.0)]
    s = spark.createDataFrame(states, USABLE + ", state_primary_pid long, state_n_contribs int, clus_q_tot double")
    hit_map = spark.createDataFrame([(0, 0, 10), (0, 1, 11), (0, 1, 12), (0, 5, 13)], "event_id long, measurement_id long, hit_id long")
    simhits = spark.createDataFrame([(0, 10, 3, 7), (0, 11, 5, 7), (0, 12, 4, 7), (0, 13, 4, 7)], "event_id long, hit_id long, particle_id long, geometry_id long")
    cells = spark.createDataFrame([(0, 1, 2, 2, 4.0), (0, 1, 3, 2, 2.0), (0, 2, 0, 0, 7.0)], "event_id long, measurement_id long, channel0 long, channel1 long, value double")
    inputs = expansion.ExpansionInputs(s, spark.createDataFrame(meas, MEAS), hit_map, simhits, cells=cells)
    got = expansion.candidate_table(inputs, N, RADIUS, 0.01, guard=False)
    assert len(got.columns) == len(set(got.columns))
    q = {(r.state_idx, r.cand_hit_id): (r.contrib_pids, r.clus_q_tot, r.clus_s_u) for r in got.collect()}
    assert q == {
        (0, 0): ([3], 9.0, None), (0, 1): ([4, 5], 6.0, 2.0), (0, 2): ([], 7.0, 1.0), (0, 3): ([], 9.0, None),
        (0, 4): ([], 9.0, None), (1, -1): ([], 8.0, None),
    }
    # Nothing is shuffled once the pairs are made: no exchange above the join on cells.
    plan = got._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("_code")].count("Exchange")
    assert above == 0


@pytest.mark.parametrize("flat, strip", [(0.0, 64), (0.5, 16)])
def test_strips_of_many_levels_match_all_pairs(spark, monkeypatch, flat, strip):
    # Narrow and wide states, sure and uncertain measurements: each pair in one strip of one level.
    monkeypatch.setattr(expand, "STRIP", strip)
    states, meas = case(60, 400, seed=3, flat=flat)
    meas += [(0, 7, 1000 + k, 20.0 * k - 90, 3.0 * k, 400.0, 0.02) for k in range(10)]
    meas += [(0, 7, 1100, None, 1.0, 0.01, 0.02), (0, 7, 1101, 1.0, None, 0.01, 0.02), (0, 7, 1102, float("nan"), 1.0, 0.01, 0.02)]
    states += [(0, 100 + k, 0, 7, 15.0 * k - 90, -2.0, None, None, 900.0, 0.0, 0.4) for k in range(12)]
    s, m = spark.createDataFrame(states, STATES), spark.createDataFrame(meas, MEAS)
    meet = expand.meeting(s, m, N, RADIUS)
    assert len(meet.levels) > 2 and len(meet.uncertain) > 2
    got = expand.window_pairs(s, m, N, RADIUS)
    pairs = [(r.track_nr, r.cand_hit_id) for r in got.collect()]
    want = plain(states, [x for x in meas if x[2] not in (1100, 1101, 1102)])
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    seen = got.groupBy("track_nr").agg(F.sum(F.col("_in_window").cast("int")).alias("w"), F.sum(F.col("_in_radius").cast("int")).alias("r"))
    counted = meet.counts(expand._columns(s, meet).drop("sel_l0", "sel_l1")).select("track_nr", "n_window", "geometric_density")
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, seen.collect()))


def crowd(spark, n_states=200, n_meas=4000):
    r = random.Random(9)
    meas = [(0, 7, k, r.uniform(0, 100), r.uniform(0, 1), 0.01, 0.02) for k in range(n_meas)]
    states = [(0, k, 0, 7, r.uniform(0, 100), 0.5, None, None, 4.0, 0.0, 1.0) for k in range(n_states)]
    return spark.createDataFrame(states, STATES), spark.createDataFrame(meas, MEAS)


@pytest.mark.parametrize("built", [True, False])
def test_join_has_a_row_for_a_chunk(spark, built):
    # the join's rows are a small part of the pairs, and most whole chunks are known to lie in the window.
    s, m = crowd(spark)
    if not built:
        s = s.withColumnsRenamed({"P00": "S00", "P01": "S01", "P11": "S11"})
    meet = expand.meeting(s, m, N, RADIUS)
    met = meet.met(s).agg(F.count(F.lit(1)), F.sum("_n"), F.sum(F.when(F.col("_whole"), F.col("_n")))).first()
    found = expand.window_pairs(s, m, N, RADIUS).count()
    assert met[0] < found / 16 and found <= met[1] < 1.5 * found and met[2] > 0.5 * found


def test_each_row_is_dealt_about_once(spark, monkeypatch):
    # what is shuffled for the join follows the rows of both sides, not the cells that windows meet.
    monkeypatch.setattr(expand, "STRIP", 1024)
    s, m = crowd(spark)
    meet = expand.meeting(s, m, N, RADIUS)
    assert meet.place(s).count() == s.count()
    dealt = meet.deal().agg(F.sum("_n"), F.count_distinct("_strip")).first()
    assert dealt[1] > 1 and dealt[0] < 1.8 * m.count()


def test_candidates_need_no_join_by_state(spark):
    # states bring their covariance along; the states' side is shuffled once, to the strips.
    s, m = crowd(spark)
    s = s.selectExpr("*", "P00 AS S00", "P01 AS S01", "P11 AS S11", "true AS is_predicted").drop("P00", "P01", "P11")
    rows = expand.expand_states(s, m, N, RADIUS).candidates
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_no_measurements_and_no_reach(spark, rows):
    s = spark.createDataFrame([(0, k, 0, 7, 1.0 * k, 0.0, None, None, 0.0, 0.0, 0.0, True) for k in range(3)], USABLE)
    m = spark.createDataFrame([(0, 7, 5, 1.0, 0.0, 0.01, 0.02), (0, 7, 6, 1.5, 9.0, 0.01, 0.02), (0, 7, 7, 2.0, 0.5, 0.01, 0.0)], MEAS)
    names = ("track_nr", "cand_hit_id", "action_taken")
    assert rows(expand.expand_states(s, m, N, 0.0).candidates, *names) == [(0, -1, 2), (1, 5, 0), (2, 7, 0)]
    assert rows(expand.expand_states(s, m.limit(0), N, 0.0).candidates, *names) == [(0, -1, 1), (1, -1, 1), (2, -1, 1)]
    assert expand.expand_states(s.limit(0), m, N, 0.0).candidates.count() == 0


def test_rounding_is_that_of_the_sql(spark):
    # Halves go away from zero, those of the product: Spark's own round takes those of the decimal.
    r = random.Random(4)
    values = [r.choice([1, -1]) * x for x in [r.uniform(0, 10.0 ** r.randrange(-7, 13)) for _ in range(3000)]]
    values += [(2 * k + 1) / 2e6 * sign for k in range(3000) for sign in (1, -1)] + [0.0, -0.0, 5e-7, 1e-7, 1e15, 2.0**60]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", registry._rounded(F.col("x")))
    con = duckdb.connect()
    for x, y in got.collect():
        assert y == con.execute("SELECT round(?::DOUBLE, 6)", [x]).fetchall()[0][0], x
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),)], "x double").select(registry._rounded(F.col("x"))).collect()
    assert odd[0][0] is None and odd[1][0] != odd[1][0] and odd[2][0] == float("inf")
