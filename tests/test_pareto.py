"""Fronts of three and four objectives against a plain comparison of all points."""

import random

import pytest

from trackspark.operators.pareto import pareto_front


def plain(points):
    def worse(a, b):
        return a != b and all(x <= y for x, y in zip(b, a, strict=True))

    return sorted(p for p in points if not any(worse(p, q) for q in points))


def frame(spark, points, parts):
    k = len(points[0])
    return spark.createDataFrame(points, ", ".join(f"v{i} double" for i in range(k))).repartition(parts)


@pytest.mark.parametrize(("k", "grid", "parts"), [(3, 6, 1), (3, 1000, 7), (4, 4, 3), (4, 50, 5), (2, 9, 3)])
def test_against_all_pairs(spark, rows, k, grid, parts):
    r = random.Random(k * grid)
    points = [tuple(float(r.randrange(grid)) for _ in range(k)) for _ in range(160)]
    points += points[:10]
    names = [f"v{i}" for i in range(k)]
    got = rows(pareto_front(frame(spark, points, parts), [(n, "min") for n in names]), *names)
    assert got == plain(points)


def test_all_points_on_the_front(spark):
    # A plane of constant sum: nobody is better everywhere; a tenth of the rows share the first objective.
    points = [(float(i % 40), float(j), -float(i % 40) - float(j)) for i in range(40) for j in range(50)]
    front = pareto_front(frame(spark, points, 9), [("v0", "min"), ("v1", "min"), ("v2", "min")])
    assert front.count() == len(points)
    plan = front._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_hot_first_objective_and_missing_values(spark, rows):
    points = [(1.0, float(i), float((i * 37) % 101)) for i in range(400)] + [(None, 0.0, 0.0), (float("nan"), 0.0, 0.0), (0.5, 50.0, 50.0)]
    df = spark.createDataFrame(points, "v0 double, v1 double, v2 double")
    got = rows(pareto_front(df, [("v0", "min"), ("v1", "max"), ("v2", "min")]), "v0", "v1", "v2")
    whole = [p for p in points if p[0] is not None and p[0] == p[0]]
    assert got == sorted((a, -b, c) for a, b, c in plain([(a, -b, c) for a, b, c in whole]))
    assert pareto_front(df.limit(0), [("v0", "min"), ("v1", "max"), ("v2", "min")]).count() == 0
