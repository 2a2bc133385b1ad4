"""Set-wise resolution against a plain priority loop on random small cases."""

import random

import pytest

from trackspark.operators import resolve
from trackspark.operators.graph import components
from trackspark.operators.resolve import resolve_shared


def sequential(tracks, max_shared, min_hits):
    """tracks: {seed: (hits, chi2)}; drop the worst branch until it shares too little."""
    alive = {s for s, (h, _) in tracks.items() if len(h) >= min_hits}
    while alive:
        def shared(s):
            return sum(any(h in tracks[t][0] for t in alive if t != s) for h in tracks[s][0])

        worst = max(alive, key=lambda s: (shared(s) / len(tracks[s][0]), -len(tracks[s][0]), tracks[s][1], -s))
        if shared(worst) < max_shared:
            break
        alive.remove(worst)
    return alive


def _case(r, n_tracks, n_hits):
    out = {}
    for s in range(n_tracks):
        k = r.randint(2, min(6, n_hits))
        out[s] = (sorted(r.sample(range(n_hits), k)), round(r.random(), 3))
    return out


@pytest.mark.parametrize(("seed", "largest"), [(0, 1_000_000), (1, 20)])
def test_equals_sequential_loop(spark, seed, largest, monkeypatch):
    """With components in one task each, all in rounds, and some of both."""
    monkeypatch.setattr(resolve, "COMPONENT_ROWS", largest)
    r = random.Random(seed)
    # Many independent events at once: each is one random case with colliding ids.
    cases = {ev: _case(r, r.randint(3, 14), r.randint(6, 18)) for ev in range(60)}
    # One hit that every branch shares.
    cases[60] = {s: ([0, 100 + s, 200 + s], 0.1 * s) for s in range(30)}
    # A chain in which each branch shares one hit with the next.
    cases[61] = {s: ([s, s + 1], 0.01 * s) for s in range(12)}
    data = [
        (ev, s, i, h, True, c / len(hits))
        for ev, tracks in cases.items()
        for s, (hits, c) in tracks.items()
        for i, h in enumerate(hits)
    ]
    df = spark.createDataFrame(
        data, "event_id long, seed_id long, step_k long, cand_hit_id long, is_ckf_selected boolean, chi2_inc double"
    )
    for max_shared, min_hits in ((1, 2), (2, 3)):
        got = {}
        for row in resolve_shared(df, max_shared, min_hits).collect():
            got.setdefault(row.event_id, set())
            if row.survived:
                got[row.event_id].add(row.seed_id)
        for ev, tracks in cases.items():
            assert got[ev] == sequential(tracks, max_shared, min_hits), (ev, max_shared)


def test_short_branch_dropped_and_disjoint_pair_kept(spark, rows):
    def branch(s, hits, chi2):
        return [(0, s, i, h, True, chi2) for i, h in enumerate(hits)]

    data = branch(1, range(8), 1.0) + branch(2, range(100, 108), 1.0) + branch(3, range(200, 203), 1.0)
    data += branch(4, [0, 1, 2, 3, 300, 301, 302, 303], 2.0)
    df = spark.createDataFrame(
        data, "event_id long, seed_id long, step_k long, cand_hit_id long, is_ckf_selected boolean, chi2_inc double"
    )
    got = rows(resolve_shared(df, 3, 7), "seed_id", "survived")
    assert got == [(1, True), (2, True), (3, False), (4, False)]


FRAME = "event_id long, seed_id long, step_k long, cand_hit_id long, is_ckf_selected boolean, chi2_inc double"


def test_a_chain_of_two_thousand_branches_ends(spark):
    n = 2000
    tracks = {s: ([s, s + 1], float((s * 7919) % n)) for s in range(n)}
    data = [(0, s, i, h, True, c / 2) for s, (hits, c) in tracks.items() for i, h in enumerate(hits)]
    left = resolve_shared(spark.createDataFrame(data, FRAME), 1, 2)
    # A plan of constant size, whatever the number of pops.
    assert len(left._jdf.queryExecution().toString()) < 60_000
    alive = {r.seed_id for r in left.collect() if r.survived}
    assert all(not (s in alive and s + 1 in alive) for s in range(n)) and 600 < len(alive) < 1400


def test_hits_listed_twice_are_refused_on_request(spark):
    df = spark.createDataFrame([(0, 1, 0, 5, True, 1.0), (0, 1, 1, 5, True, 1.0), (0, 2, 0, 5, True, 1.0)], FRAME)
    assert {(r.seed_id, r.survived) for r in resolve_shared(df, 1, 1).collect()} == {(1, False), (2, True)}
    with pytest.raises(ValueError, match="twice"):
        resolve_shared(df, 1, 1, refuse_repeats=True)
    with pytest.raises(ValueError, match="max_shared"):
        resolve_shared(df, 0, 1)


def test_components_inside_groups(spark):
    r = random.Random(3)
    order = list(range(500))
    r.shuffle(order)
    links = [(1, a, b) for a, b in zip(order, order[1:])] + [(2, 7, k) for k in range(8, 400)] + [(3, 1, 1), (3, 5, 4)]
    got = {(g, n): c for g, n, c in components(spark.createDataFrame(links, "g long, x long, y long"), ["g"], "x", "y").collect()}
    want = {(1, k): 0 for k in range(500)} | {(2, k): 7 for k in range(7, 400)} | {(3, 4): 4, (3, 5): 4}
    assert got == want
    assert components(spark.createDataFrame([], "g long, x long, y long"), ["g"], "x", "y").count() == 0
