"""Whitening against numpy, exact sums, and awkward tables."""

import numpy as np
import pytest

from trackspark.llm import model_queries, whitening

VEC = "vec_id long, embedding array<float>, label int"


def made(spark, vectors, ids=None):
    rows = [(i if ids is None else ids[i], None if v is None else [None if c is None else float(c) for c in v], 0) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, VEC)


def expected(vectors):
    x = np.floor(256 * np.array(vectors, np.float32).astype(float)).astype(int)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    v = (fit - s / n).T @ (fit - s / n) / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    return n, [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for row in x], (x - s / n) @ q[:, :4] / np.sqrt(e[:4]), e / e.sum()


@pytest.mark.parametrize("slices", [1, 7])
def test_against_numpy(spark, slices, tmp_path, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 16)
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 1)
    monkeypatch.setattr(whitening, "BLOCK_COLS", 4)
    monkeypatch.setattr(whitening, "BLOCKS_PER_TASK", 2)
    rng = np.random.default_rng(2)
    vectors = [list(v) for v in rng.normal(size=(200, 10)) * np.arange(1, 11)]
    vectors += [vectors[3]] * 100  # a third of the rows are equal
    bad = [None, [None] + [1.0] * 9, [float("nan")] * 10, [float("inf")] + [0.0] * 9]
    made(spark, vectors + bad).repartition(slices).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = model_queries.op13_whitening(spark, str(tmp_path)).toPandas().set_index(["vec_id", "component"]).sort_index()
    assert len(got) == 4 * len(vectors)
    n, deviations, white, explained = expected(vectors)
    assert set(got["n"]) == {n}
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9
    for c in range(4):
        part = got.xs(c + 1, level="component")
        assert list(part["deviation"]) == deviations
        sign = np.sign(part["whitened"].iloc[0] * white[0, c])
        np.testing.assert_allclose(part["whitened"] * sign, white[:, c], atol=1e-9)
        np.testing.assert_allclose(part["explained"], explained[c], rtol=1e-9)


def test_degenerate_tables(spark):
    assert whitening.whiten(made(spark, [])).count() == 0
    assert whitening.whiten(made(spark, [[], None])).count() == 0
    same = whitening.whiten(made(spark, [[1.0, 2.0]] * 5)).collect()
    assert len(same) == 10 and all(r["whitened"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in same)
    # Rank one: the second component has no variance.
    line = whitening.whiten(made(spark, [[t, 2 * t] for t in (0.0, 1.0, 3.0)])).collect()
    assert sorted(r["component"] for r in line if r["whitened"] is not None) == [1, 1, 1]
    assert line[0]["identity_error"] < 1e-9
    # Shorter vectors are padded; null and repeated ids stay.
    ragged = whitening.whiten(made(spark, [[1.0], [1.0, 0.0], [0.0, 1.0], [2.0, 2.0]], [None, None, 7, 7])).collect()
    assert len(ragged) == 8 and {r["n"] for r in ragged} == {3}
    huge = whitening.whiten(made(spark, [[3e38, 1.0], [1.0, 2.0], [0.0, 5.0]])).collect()
    assert len(huge) == 6


def test_clashing_names(spark):
    df = made(spark, [[1.0, 2.0], [2.0, 0.0], [0.0, 5.0]]).selectExpr("vec_id as n", "embedding", "label as index", "label as `a.b`", "vec_id as whitened")
    got = whitening.whiten(df)
    assert got.columns == ["n", "index", "a.b", "whitened", "component", "_n", "deviation", "_whitened", "explained", "identity_error"]
    assert got.count() == 6
