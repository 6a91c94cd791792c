"""Whitening against NumPy's eigenvectors of the covariance formed whole."""

import math

import numpy as np
import pytest

from ledgerline.llm import whitening

COLUMNS = ["component", "n", "deviation", "whitened", "explained", "identity_error"]


def frame(spark, vectors, kind="float"):
    return spark.createDataFrame([(i, v, "a", 1) for i, v in enumerate(vectors)], f"vec_id long, embedding array<{kind}>, key string, x int")


def brute(vectors, k=8):
    x = np.array([[math.floor(1024 * float(c)) + 100000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(0)
    deviation = ((x * n - s) ** 2).sum(1)
    c = x.astype(float) - np.array([v / n for v in s])
    cov = c.T @ c / n
    e, u = np.linalg.eigh(cov)
    return n, deviation, c, e[::-1][:k], u[:, ::-1][:, :k], np.trace(cov)


def compare(rows, ids, vectors, k=8, tol=1e-7):
    n, deviation, c, e, u, trace = brute(vectors, k)
    assert len(rows) == len(ids) * len(e)
    place = {v: i for i, v in enumerate(ids)}
    w = np.zeros((len(ids), len(e)))
    for r in rows:
        i = place[r["vec_id"]]
        assert r["n"] == n and r["deviation"] == deviation[i] and r["identity_error"] < 1e-9
        assert r["explained"] == pytest.approx(e[r["component"] - 1] / trace, rel=1e-9)
        w[i, r["component"] - 1] = r["whitened"]
    want = c @ u / np.sqrt(e)
    signs = np.sign((w * want).sum(0))
    assert np.abs(w * signs - want).max() < tol


def test_equals_whole_eigenvectors(spark):
    rng = np.random.default_rng(3)
    x = (rng.standard_normal((1500, 64)) * np.linspace(1, 1.6, 64) / 8 + 0.3).astype(np.float32)
    rows = whitening.whitened(frame(spark, x.tolist())).collect()
    compare(rows, range(len(x)), x)
    assert max(r["residual"] for r in rows) < 1e-12


def test_close_eigenvalues_and_table(spark):
    """The given table, where the eighth eigenvalue stands a percent above the ninth."""
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    given = rows.collect()
    compare(whitening.whitened(rows).collect(), [r["vec_id"] for r in given], [r["embedding"] for r in given])


def test_rows_that_go_and_few_dimensions(spark):
    good = [[0.1, 0.2, -0.5], [0.4, 0.0, 0.5], [0.3, 0.9, 0.1], [0.3, 0.9, 0.1], [-0.7, 0.2, 0.2]]
    bad = [None, [0.1, None, 0.2], [0.1, float("nan"), 0.2], [float("inf"), 0.0, 0.0], [], [1.0, 2.0], [1e300, 0.0, 0.0]]
    rows = whitening.whitened(frame(spark, good + bad, "double")).collect()
    compare(rows, range(5), good, k=3)


def test_no_variance_and_no_rows(spark):
    assert whitening.whitened(frame(spark, [])).count() == 0
    assert whitening.whitened(frame(spark, [[0.5, 0.5]] * 4)).count() == 0
    one_way = [[i / 8, 0.25, 0.5] for i in range(9)]
    rows = whitening.whitened(frame(spark, one_way)).collect()
    assert {r["component"] for r in rows} == {1}
    compare(rows, range(9), one_way, k=1)


def test_large_numbers_stay_exact(spark):
    far = [[4e9 + i, -3.5 * i] for i in range(6)]
    rows = whitening.whitened(frame(spark, far, "double")).collect()
    n, deviation, *_ = brute(far)
    assert {r["vec_id"]: r["deviation"] for r in rows} == dict(enumerate(deviation))
