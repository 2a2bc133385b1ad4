"""Ordered primitives against brute force, with and without chunks and across partitionings."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from trackspark.operators import ordered as o


def _frame(spark, n=400, seed=1):
    r = random.Random(seed)
    data = []
    for ev in (0, 1):
        for key in (0, 1, 2):
            size = n if key == 0 else 7  # one group holds most rows
            steps = r.sample(range(3 * n), size)
            data += [(ev, key, s, r.choice([None, r.randint(-5, 9)])) for s in steps]
    return data, spark.createDataFrame(data, "event_id long, seed_id long, step_k long, v long")


def _brute(data, inclusive, descending):
    out = {}
    groups = {}
    for ev, k, s, v in data:
        groups.setdefault((ev, k), []).append((s, v))
    for g, items in groups.items():
        items.sort(reverse=descending)
        for i, (s, _) in enumerate(items):
            frame = [v for _, v in items[: i + (1 if inclusive else 0)] if v is not None]
            out[(*g, s)] = (sum(frame), min(frame) if frame else None, frame[-1] if frame else None)
    return out


@pytest.mark.parametrize("width", [o.CHUNK_WIDTH, 50])
@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("descending", [True, False])
def test_running_matches_brute_force(spark, width, inclusive, descending):
    data, df = _frame(spark)
    got = o.running(
        df,
        ["event_id", "seed_id"],
        "step_k",
        sums={"s": "v"},
        mins={"m": "v"},
        lasts={"l": "v"},
        inclusive=inclusive,
        descending=descending,
        width=width,
    )
    seen = {(r.event_id, r.seed_id, r.step_k): (r.s, r.m, r.l) for r in got.collect()}
    assert seen == _brute(data, inclusive, descending)


@pytest.mark.parametrize("width", [o.CHUNK_WIDTH, 50])
@pytest.mark.parametrize("forward", [True, False])
def test_shifted_matches_brute_force(spark, width, forward):
    data, df = _frame(spark)
    got = o.shifted(df, ["event_id", "seed_id"], "step_k", {"n": "step_k"}, forward=forward, width=width)
    groups = {}
    for ev, k, s, _ in data:
        groups.setdefault((ev, k), []).append(s)
    want = {}
    for g, steps in groups.items():
        steps.sort()
        for i, s in enumerate(steps):
            j = i + (1 if forward else -1)
            want[(*g, s)] = steps[j] if 0 <= j < len(steps) else None
    assert {(r.event_id, r.seed_id, r.step_k): r.n for r in got.collect()} == want


@pytest.mark.parametrize("partitions", [1, 8])
def test_value_prefix_and_percentiles(spark, partitions):
    r = random.Random(3)
    data = [(r.choice("ab"), round(r.gauss(0, 1), 1)) for _ in range(3000)]
    data += [("a", 0.5)] * 3000  # a value shared by half of the rows
    df = spark.createDataFrame(data, "g string, x double").repartition(partitions)
    merged = df.groupBy("g", "x").agg(F.count(F.lit(1)).alias("c"))
    p = o.value_prefix(merged, "x", {"c": "c"}, by=["g"], buckets=7)
    for row in p.collect():
        assert row.c_before == sum(1 for g, x in data if g == row.g and x < row.x)
        assert row.c_total == sum(1 for g, _ in data if g == row.g)
    q = o.exact_percentiles(df, "x", [0.0, 0.31, 0.5, 1.0], by=["g"])
    got = {(t.g, t.q): t.value for t in q.collect()}
    for g in "ab":
        xs = sorted(x for h, x in data if h == g)
        for prob in (0.0, 0.31, 0.5, 1.0):
            pos = prob * (len(xs) - 1)
            lo = int(pos)
            hi = min(lo + 1, len(xs) - 1)
            assert got[(g, prob)] == pytest.approx(xs[lo] + (xs[hi] - xs[lo]) * (pos - lo), abs=1e-12)
    assert got[("a", 0.5)] == statistics.median(x for h, x in data if h == "a")


def test_row_index_is_a_permutation(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") % 10).alias("v"))
    got = sorted((r.i, r.v, r.id) for r in o.row_index(df, "v", "i", ties=["id"]).collect())
    assert [g[0] for g in got] == list(range(500))
    assert [(g[1], g[2]) for g in got] == sorted((g[1], g[2]) for g in got)


def test_average_rank_shares_ties(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (5.0,)], "x double")
    assert {r.x: r["rank"] for r in o.average_rank(df, "x").collect()} == {1.0: 1.0, 2.0: 2.5, 5.0: 4.0}


def test_running_sums_are_the_same_bits_at_every_width(spark):
    r = random.Random(4)
    data = [(0, k, s, r.choice([None, r.uniform(-1e6, 1e6), r.uniform(-1e-6, 1e-6)])) for k in range(3) for s in r.sample(range(900), 300)]
    df = spark.createDataFrame(data, "event_id long, seed_id long, step_k long, v double")

    def sums(width, parts):
        got = o.running(df.repartition(parts), ["event_id", "seed_id"], "step_k", sums={"s": "v"}, width=width)
        assert dict(got.dtypes)["s"] == "double"
        return {(x.seed_id, x.step_k): x.s.hex() for x in got.collect()}

    assert sums(o.CHUNK_WIDTH, 3) == sums(50, 7) == sums(7, 1)


def test_first_by_key_takes_whole_rows(spark):
    data = [(1, 3, None, "a"), (1, 2, 5, "b"), (1, 2, 4, "c"), (None, 9, 1, "d"), (None, 8, None, None), (2, None, 7, "e")]
    df = spark.createDataFrame(data, "k long, o long, v long, `t x` string")
    got = {tuple(x) for x in o.first_by_key(df.repartition(5), ["k"], ["o", "v"]).collect()}
    assert got == {(1, 2, 4, "c"), (None, 8, None, None), (2, None, 7, "e")}
    assert o.first_by_key(df, ["k"], ["o", "v"]).columns == df.columns


@pytest.mark.parametrize("width", [o.CHUNK_WIDTH, 50])
def test_rows_with_null_keys_are_one_group(spark, width):
    data = [(None, s, s % 3) for s in range(0, 400, 2)] + [(1, s, 1) for s in range(300)]
    df = spark.createDataFrame(data, "k long, step_k long, v long").repartition(6)
    got = o.shifted(o.running(df, ["k"], "step_k", sums={"s": "v"}, width=width), ["k"], "step_k", {"n": "v"}, width=width)
    seen = {(r.k, r.step_k): (r.s, r.n) for r in got.collect()}
    for key in (None, 1):
        rows = [(s, v) for k, s, v in data if k == key]
        for i, (s, _) in enumerate(rows):
            assert seen[key, s] == (sum(v for _, v in rows[: i + 1]), rows[i + 1][1] if i + 1 < len(rows) else None)


def test_running_plans_without_jobs_and_short_groups_take_one_shuffle(spark, tmp_path):
    data, df = _frame(spark)
    df.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    spark.sparkContext.setJobGroup("planning", "no job may start")
    keys = ["event_id", "seed_id"]
    passes = o.passes_chunk(df, "step_k")
    s = o.running(o.in_chunks(df, keys, "step_k"), keys, "step_k", sums={"s": "v"}, passes=passes)
    s = o.running(s, keys, "step_k", lasts={"l": F.when(F.col("v") > 0, F.col("s"))}, descending=True, passes=passes)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("planning")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(s.collect()) == len(data)
    final = s._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Join" not in final and final.count("Exchange hashpartitioning") == 1
