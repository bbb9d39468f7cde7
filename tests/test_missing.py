"""Missing entries, read counts, and the sizes and draws of submatrices."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from countloom.bundle import CountMatrix
from countloom.operators import fit, scaling
from countloom.session import cut


def matrix(spark, x):
    """Stored cells of an array; NaN stays, zeros are not stored."""
    at = np.nonzero(x)
    t = pa.table({"row_id": at[0].astype(np.int64), "col_id": at[1].astype(np.int64), "value": x[at].astype(float)})
    axis = lambda n, c: spark.range(n).select(F.col("id").alias(c))
    return CountMatrix(cut(spark.createDataFrame(t), "array"), axis(x.shape[0], "row_id"), axis(x.shape[1], "col_id"))


def vector(df):
    return np.array([r[1] for r in sorted(df.collect())])


def sinkhorn(v, n=2000):
    u = np.ones(v.shape[0])
    for _ in range(n):
        w = v.shape[0] / (v.T @ u)
        u = v.shape[1] / (v @ w)
    return u, w


def test_missing_entries(spark):
    """Rank five of which a tenth is not observed."""
    rng = np.random.default_rng(42)
    x = np.exp(2 * rng.standard_normal((1000, 5))) @ rng.uniform(size=(5, 500))
    x = np.where(rng.random(x.shape) < 0.9, x, np.nan)
    f = fit.fit(matrix(spark, x), tol=2e-3, n_iter=1000, size=(200, 200), n_subsamples=2, qits=11)
    assert f.rank == 5 and f.observed.share == pytest.approx(np.isfinite(x).mean())
    assert f.y.cells.where(F.isnan("value")).isEmpty()


def test_scaling_with_missing_entries(spark):
    """The block loop, the scaled matrix and the fold-in of new rows against NumPy."""
    rng = np.random.default_rng(1)
    x = rng.poisson(np.outer(rng.uniform(1, 6, 70), rng.uniform(1, 3, 30))).astype(float) + 1
    lost = rng.random(x.shape) < rng.uniform(0.05, 0.4, 30)
    full = np.where(lost, np.nan, x)
    old, new = full[:60], full[60:]
    f = fit.fit(matrix(spark, old), {"bhat": 0.9, "chat": 0.05}, refit=False)

    def variance(part, cols, share):
        p = np.minimum(np.isfinite(part).mean(1, keepdims=True) * cols / share, 1)
        z = np.nan_to_num(part)
        return 0.9 * p * z + (1 - 0.95 * p) * z * z

    cols, share = np.isfinite(old).mean(0), np.isfinite(old).mean()
    u, v = sinkhorn(variance(old, cols, share))
    scale = math.sqrt(vector(f.u)[0] / u[0])
    assert vector(f.u) / scale**2 == pytest.approx(u, rel=1e-5) and vector(f.v) * scale**2 == pytest.approx(v, rel=1e-5)
    got = f.predict(matrix(spark, new), counts=True, truncate=False, library_normalize=False)
    y = np.sqrt(u)[:, None] * np.nan_to_num(old) * np.sqrt(v)
    own = 30 / (variance(new, cols, share) @ v)
    z = np.sqrt(own)[:, None] * np.nan_to_num(new) * np.sqrt(v)
    _, s, vt = np.linalg.svd(y, full_matrices=False)
    want = (z @ vt[: f.rank].T / s[: f.rank] * fit.shrunk(s[: f.rank], 30, 60, f.sigma)) @ vt[: f.rank]
    back = np.zeros_like(want)
    for r in got.collect():
        back[r["row_id"], r["col_id"]] = r["value"]
    assert back == pytest.approx(want, abs=1e-4)


def test_read_counts(spark):
    x = np.array([[1, 1, 2], [2, 1, 1], [0, 1, 2]], float)
    f = fit.fit(matrix(spark, x), read_counts=2, tol=2e-3, n_iter=1000, refit=False)
    assert f.parameters["c"] == pytest.approx(-0.5) and f.parameters["b"] == pytest.approx(1)
    var = {(r[0], r[1]): r[2] for r in f.m.cells.select("row_id", "col_id", f._variance()).collect()}
    assert all(var[i, j] == pytest.approx(2 * x[i, j] - x[i, j] ** 2) for i, j in var)
    for bad in (1, 0):
        with pytest.raises(ValueError):
            fit.fit(matrix(spark, x), read_counts=bad)


def test_read_counts_of_columns(spark):
    rng = np.random.default_rng(2)
    k = rng.integers(3, 9, 20)
    x = rng.binomial(k, rng.uniform(0.2, 0.6, (50, 1)), (50, 20)).astype(float)
    counts = spark.createDataFrame([(i, int(c)) for i, c in enumerate(k)], "col_id long, counts int")
    u, v = sinkhorn(x * (k - x) / (k - 1))
    for refit in (False, True):
        f = fit.fit(matrix(spark, x), read_counts=counts, refit=refit)
        a, b = vector(f.u), vector(f.v)
        y = np.sqrt(u)[:, None] * x * np.sqrt(v)
        sigma = f.parameters["sigma_residual"] if refit else 1.0
        got = np.zeros_like(y)
        for r in f.y.cells.collect():
            got[r["row_id"], r["col_id"]] = r["value"]
        assert got == pytest.approx(y / sigma, rel=1e-4, abs=1e-6) and np.outer(a, b) * sigma**2 == pytest.approx(np.outer(u, v), rel=1e-4)
    again = scaling.fold_in(fit._extended(matrix(spark, x[:5]), None, counts).cells, f._variance(), f.v, 20)
    assert vector(again) == pytest.approx(a[:5], rel=1e-4)
    with pytest.raises(ValueError):
        fit.fit(matrix(spark, x), read_counts=counts.withColumn("counts", F.lit(1)))


def test_sizes():
    """The rules for pairs, for one side, and for the matrix' proportion."""
    m, n = 380, 570
    size = fit.submatrix_size
    assert size((m, n), (m - 1, n - 1)) == (m - 1, n - 1)
    assert size((m, n), (m + 1, n + 1)) == (m, n)
    assert size((m, n), (None, 300)) == (300, 300) and size((m, n), (None, n - 10)) == (m, n - 10)
    assert size((m, n), (None, n - 10), keep_aspect=True) == (math.floor(m / n * (n - 10)), n - 10)
    assert size((m, n), (m - 10, 0), keep_aspect=True) == (m - 10, math.floor(n / m * (m - 10)))
    assert size((m, n), 200) == (200, 200) and size((n, m), 200, keep_aspect=True) == (300, 200)
    assert size((m, n), m) == size((m, n), 1000) == size((m, n), 0) == size((m, n), None) == size((m, n), (None, 0)) == (m, n)
    assert size((m, n), m, keep_aspect=True) == (m, n)
    with pytest.raises(ValueError):
        size((m, n), (1, 2, 3))


def test_submatrices_against_local_fits(spark):
    rng = np.random.default_rng(3)
    x = rng.poisson(np.outer(rng.uniform(1, 4, 60), rng.uniform(1, 4, 40))).astype(float)
    m = matrix(spark, x)
    got = fit.quadratic_fits(m, size=(30, None), n_subsamples=3, qits=4)
    assert got.count() == 15
    for i in range(3):
        cells = fit.draw(m, (30, 30), 42 + i).collect()
        z = np.zeros((30, 30))
        for r in cells:
            z[r["r"], r["c"]] = r["value"]
        for r in got.where(F.col("submatrix") == i).collect():
            assert (r["sigma"], r["kst"]) == pytest.approx(fit.local_fit(fit.stable(z, 2), r["q"]), rel=1e-6)
    whole = fit.quadratic_fits(m, size=40, n_subsamples=3, qits=2)
    assert {r[0] for r in whole.select("submatrix").collect()} == {0}


def test_empty_draws_are_drawn_again(spark):
    """A few dense lines among empty ones: most draws keep nothing."""
    x = np.zeros((40, 40))
    x[:14, :14] = np.random.default_rng(4).poisson(5, (14, 14)) + 1
    got = fit.quadratic_fits(matrix(spark, x), size=(6, 6), n_subsamples=2, qits=2, tries=200)
    assert {r[0] for r in got.select("submatrix").collect()} == {0, 1}
    with pytest.raises(ValueError, match="keep no line"):
        fit.quadratic_fits(matrix(spark, np.eye(12)), size=(6, 6), n_subsamples=2, qits=2, tries=2)
