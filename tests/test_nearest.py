"""The nearest truth measurement against all pairs, in one block and in many, with ties and hot values."""

import math
import random

import pytest

from trackspark.operators import expand, nearest

STATES = "event_id int, track_nr long, state_idx long, geometry_id long, branch_majority_pid long, pred_l0 double, pred_l1 double, S00 double, S11 double"
TRUTH = "event_id long, geometry_id long, particle_id int, measurement_id long, local0 double, local1 double, var_local1 double"


def plain(states, truth):
    out = set()
    for s in states:
        best = None
        for m in truth:
            if (s[0], s[3], s[4]) != m[:3] or None in (s[4], m[4], s[5], s[7]) or s[7] <= 0:
                continue
            d = abs(m[4] - s[5]) / math.sqrt(s[7])
            if m[6] is not None and m[6] > 0:
                if None in (m[5], s[6], s[8]) or s[8] <= 0:
                    continue
                d = max(d, abs(m[5] - s[6]) / math.sqrt(s[8]))
            best = min(best or (d, m[3]), (d, m[3]))
        if best:
            out.add((*s[:3], best[1], best[0]))
    return out


@pytest.mark.parametrize("block", [16, 1 << 16])
def test_nearest_truth_matches_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(nearest, "BLOCK", block)
    monkeypatch.setattr(nearest, "STATES", block)
    monkeypatch.setattr(nearest, "LEAF", 4)
    r = random.Random(3)
    value = lambda: r.choice([r.uniform(-10, 10), float(r.randrange(-3, 4)), 1.0])
    truth = [(0, 7, k % 3 % 2, k, value(), r.choice([value(), None]), r.choice([0.02, 0.02, -1.0, None])) for k in range(900)]
    truth += [(0, 7, 0, 900, None, 0.0, 0.1), (0, 8, 0, 901, 1e6, 2.0, 0.1), (1, 7, None, 902, 0.0, 0.0, 0.1)]
    spread = lambda: r.choice([0.01, 0.5, 1e4, 1e8])
    states = [(0, k, 0, 7, k % 2, value(), value(), spread(), spread()) for k in range(150)]
    states += [(0, 150, 0, 8, 0, 0.0, 0.0, 1.0, 1.0), (0, 151, 0, 9, 0, 0.0, 0.0, 1.0, 1.0), (0, 152, 0, 7, 0, None, 0.0, 1.0, 1.0)]
    states += [(0, 153, 0, 7, 0, 0.0, None, 1.0, 1.0), (0, 154, 0, 7, 0, 0.0, 0.0, None, 1.0), (0, 155, 0, 7, 0, 0.0, 0.0, 1.0, 0.0), (1, 156, 0, 7, None, 0.0, 0.0, 1.0, 1.0)]
    got = expand.nearest_truth(spark.createDataFrame(states, STATES), spark.createDataFrame(truth, TRUTH))
    assert {tuple(x) for x in got.select("event_id", "track_nr", "state_idx", "true_hit_id", "d_max").collect()} == plain(states, truth)


def test_nearest_truth_makes_no_pairs(spark):
    # 40,000 states by 40,000 measurements of one particle: 1.6 thousand million pairs.
    states = spark.range(40_000).selectExpr("0 AS event_id", "id AS track_nr", "0L AS state_idx", "7L AS geometry_id", "1L AS branch_majority_pid", "id * 1D AS pred_l0", "0D AS pred_l1", "1D AS S00", "1D AS S11")
    truth = spark.range(40_000).selectExpr("0 AS event_id", "7L AS geometry_id", "1L AS particle_id", "id AS measurement_id", "id + 0.25D AS local0", "0D AS local1", "1D AS var_local1")
    got = expand.nearest_truth(states, truth)
    assert got.where("true_hit_id = track_nr AND d_max = 0.25").count() == 40_000
    assert "CoGroup" in got._jdf.queryExecution().optimizedPlan().toString()
