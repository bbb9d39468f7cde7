"""The estimator, and the registered queries without SQL, against NumPy."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from countloom.bundle import CountMatrix, subsample
from countloom.operators import experiments as X, fit, lanczos, scaling, spectrum
from countloom.plans import catalog
from countloom.session import cut
from countloom.sources import simulate

SF = "/root/testdata/sf0.001"


def dense(cells, rows, cols):
    out = np.zeros((len(rows), len(cols)))
    at, to = {k: i for i, k in enumerate(rows)}, {k: i for i, k in enumerate(cols)}
    for r in cells.select("row_id", "col_id", "value").collect():
        out[at[r[0]], to[r[1]]] = r[2]
    return out


def axes(m):
    return sorted(r[0] for r in m.obs.select("row_id").collect()), sorted(r[0] for r in m.var.select("col_id").collect())


def sinkhorn(v, n=200):
    u = np.ones(v.shape[0])
    for _ in range(n):
        w = v.shape[0] / (v.T @ u)
        u = v.shape[1] / (v @ w)
    return u, w


class Numpy:
    """The same fit on a dense matrix."""

    def __init__(self, x, bhat=1.0, chat=0.0, refit=True):
        self.x, self.p = x, (bhat, chat)
        self.u, self.v = sinkhorn(bhat * x + chat * x * x)
        y = np.sqrt(self.u)[:, None] * x * np.sqrt(self.v)
        self.m, self.n = sorted(x.shape)
        s = np.linalg.svd(y, compute_uv=False)
        self.residual = spectrum.noise_scale(s, self.m, self.n)
        if refit:
            self.v, y = self.v / self.residual**2, y / self.residual
            self.p = tuple(t * self.residual**2 for t in self.p)
        self.y, self.sigma = y, 1.0 if refit else self.residual
        self.U, self.s, self.Vt = np.linalg.svd(y, full_matrices=False)
        self.rank = spectrum.mp_rank(self.s, self.m, self.n, self.sigma)

    def shrunk(self, kind="frobenius"):
        return fit.shrunk(self.s[: self.rank], self.m, self.n, self.sigma, kind)

    def low(self, kind="frobenius"):
        r = self.rank
        return (self.U[:, :r] * self.shrunk(kind)) @ self.Vt[:r]


@pytest.fixture(scope="module")
def m(spark):
    return simulate.counts(spark, 60, 25, rank=3, library=4000.0, seed=5).settled()


@pytest.mark.parametrize("limit", [5000, 6])
@pytest.mark.parametrize("flip", [False, True])
def test_transform(spark, m, monkeypatch, limit, flip):
    """Both orientations, by the Gram matrix and by products with few vectors."""
    monkeypatch.setattr(spectrum, "GRAM_LIMIT", limit)
    monkeypatch.setattr(spectrum, "STARTS", 25 * 400)
    monkeypatch.setattr(spectrum, "CELLS", 100)
    c = m.transpose() if flip else m
    rows, cols = axes(c)
    x = dense(c.cells, rows, cols)
    want, f = Numpy(x), fit.fit(c, {"bhat": 1.0, "chat": 0.0})
    assert f.rank == want.rank > 0
    if limit == 5000:
        assert f.parameters["sigma_residual"] == pytest.approx(want.residual, rel=1e-6) and f.factors.whole
        assert f.kst == pytest.approx(spectrum.ks(want.s, want.m, want.n, 1.0), abs=1e-6)
    else:  # sigma comes from what is known of the spectrum
        scale = f.parameters["sigma_residual"]
        want = Numpy(x, refit=False)
        want.y, want.s, want.v, want.sigma = want.y / scale, want.s / scale, want.v / scale**2, 1.0
        assert len(f.factors.s) < 25
    near = lambda cells, z: dense(cells, rows, cols) == pytest.approx(z, abs=1e-4)
    z = want.low()
    assert near(f.transform(truncate=False, library_normalize=False), z)
    assert near(f.transform(denoised=False), want.y)
    plus = np.maximum(z, 0)
    assert near(f.transform(library_normalize=100.0), plus / plus.sum(1, keepdims=True) * 100)
    back = plus / np.sqrt(np.outer(want.u, want.v))
    assert dense(f.transform(unscale=True), rows, cols) == pytest.approx(back / back.sum(1, keepdims=True) * np.median(x.sum(1)), rel=1e-3, abs=1e-3)
    q = np.abs(np.quantile(want.low("hard"), 0.2, axis=1, keepdims=True))
    assert near(f.transform(library_normalize=False, shrinker="hard", truncate=0.2, truncation_axis=1), np.where(want.low("hard") > q, want.low("hard"), 0))
    for which, lines, full in (("left", rows, want.U), ("right", cols, want.Vt.T)):
        got = {r[0]: r[1] for r in f.transform(counts=False, which=which).collect()}
        assert np.abs([got[i] for i in lines]) == pytest.approx(np.abs(full[:, : want.rank] * want.shrunk()), abs=1e-4)
    with pytest.raises(ValueError):
        f.transform(shrinker="none")


@pytest.mark.parametrize("flip", [False, True])
@pytest.mark.parametrize("axis", [0, 1])
def test_predict(spark, m, flip, axis):
    c = m.transpose() if flip else m
    rows, cols = axes(c)
    key, lines = ("row_id", rows) if axis == 0 else ("col_id", cols)
    some = lines[::7]
    part = lambda keep: c.submatrix(**{("rows" if axis == 0 else "cols"): (c.obs if axis == 0 else c.var).where(F.col(key).isin(some) == keep)})
    old, new = part(False), part(True)
    f = fit.fit(old, {"bhat": 1.0, "chat": 0.0})
    want = Numpy(dense(old.cells, *axes(old)))
    r, x = want.rank, dense(new.cells, *axes(new))
    if axis == 0:
        u = x.shape[1] / (want.p[0] * x @ want.v)
        y = np.sqrt(u)[:, None] * x * np.sqrt(want.v)
        near = y @ want.Vt[:r].T / want.s[:r]
        z = (near * want.shrunk()) @ want.Vt[:r]
        back = np.maximum(z, 0) / np.sqrt(np.outer(u, want.v))
    else:
        v = x.shape[0] / (want.p[0] * x.T @ want.u)
        y = np.sqrt(want.u)[:, None] * x * np.sqrt(v)
        near = (want.U[:, :r].T @ y).T / want.s[:r]
        z = want.U[:, :r] @ (near * want.shrunk()).T
        back = np.maximum(z, 0) / np.sqrt(np.outer(want.u, v))
    assert dense(f.predict(new, axis=axis, truncate=False, library_normalize=False), *axes(new)) == pytest.approx(z, abs=1e-5)
    assert dense(f.predict(new, axis=axis, unscale=True, library_normalize=False), *axes(new)) == pytest.approx(back, rel=1e-4, abs=1e-5)
    got = {r[0]: r[1] for r in f.predict(new, axis=axis, counts=False).collect()}
    assert np.abs([got[i] for i in some]) == pytest.approx(np.abs(near * want.shrunk()), abs=1e-5)


def test_long_axes_raise_rather_than_cut(spark, m, monkeypatch):
    x = dense(m.cells, *axes(m))
    monkeypatch.setattr(spectrum, "GRAM_LIMIT", 10)
    with pytest.raises(ValueError, match="components"):
        spectrum.svd(m)
    for bad in (0, 26):
        with pytest.raises(ValueError):
            spectrum.svd(m, bad)
    f = spectrum.svd(m, 4)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    assert f.s == pytest.approx(s[:4], rel=1e-6) and not f.whole
    assert dense(spectrum.reconstruct(m, f, f.s), *axes(m)) == pytest.approx((u[:, :4] * s[:4]) @ vt[:4], abs=1e-3)
    monkeypatch.setattr(spectrum, "FACTOR_BYTES", 1000)
    with pytest.raises(ValueError, match="bytes"):
        spectrum.svd(m, 4)


@pytest.mark.parametrize("planted", [10, 0])
def test_spectrum_of_a_long_axis(spark, monkeypatch, planted):
    """Noise and components on an axis ten times the limit: rank as NumPy's, sigma within a hundredth, residuals as they are."""
    rng = np.random.default_rng(planted)
    x = rng.normal(size=(600, 1000))
    x += (rng.normal(size=(600, planted)) * np.linspace(2, 0.5, max(planted, 1))[:planted]) @ rng.normal(size=(planted, 1000))
    at, to = np.indices(x.shape)
    cells = spark.createDataFrame(pa.table({"row_id": at.ravel(), "col_id": to.ravel(), "value": x.ravel()}))
    c = CountMatrix(cut(cells, "noise"), spark.range(600).select(F.col("id").alias("row_id")), spark.range(1000).select(F.col("id").alias("col_id")))
    s = np.linalg.svd(x, compute_uv=False)
    sigma = spectrum.noise_scale(s, 600, 1000)
    monkeypatch.setattr(spectrum, "GRAM_LIMIT", 60)
    monkeypatch.setattr(spectrum, "STARTS", 600 * 100)
    f, got, rank, kst = spectrum.spectrum_of(c)
    assert got == pytest.approx(sigma, rel=0.01) and rank == spectrum.mp_rank(s, 600, 1000, sigma) == planted
    assert kst == pytest.approx(spectrum.ks(s, 600, 1000, sigma), abs=0.02)
    assert f.s == pytest.approx(s[:planted], rel=1e-6) and len(f.residuals) == planted
    assert not planted or f.residuals == pytest.approx(np.linalg.norm(x @ (x.T @ f.v) - f.v * f.s**2, axis=0), abs=1e-4 * s[0])
    few = spectrum.svd(c, 3)
    assert few.s == pytest.approx(s[:3], rel=1e-6)


def test_unsettled_spectra_raise():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 400))
    s = np.linalg.svd(x, compute_uv=False)
    space = lanczos.Subspace(lambda q: x @ (x.T @ q), 300)
    with pytest.raises(RuntimeError):
        lanczos.leading(space, above=s[3] ** 2 * (1 + 1e-12), passes=3)
    whole = lanczos.Subspace(lambda q: x[:5, :5] @ x[:5, :5].T @ q, 5)
    assert len(lanczos.leading(whole, above=0.0).values) == 5
    with pytest.raises(ValueError, match="only"):
        lanczos.leading(whole, k=6)
    with pytest.raises(ValueError, match="bytes"):
        lanczos.Subspace(lambda q: q, 1000, room=1000)


def test_join_loop_agrees_with_the_block_loop(spark, m, monkeypatch):
    near = [{r[0]: r[1] for r in t.collect()} for t in scaling.fit(m, F.col("value"), tol=1e-9)[:2]]
    monkeypatch.setattr(scaling, "CHUNK", 4)
    monkeypatch.setattr(scaling, "VECTOR_LIMIT", 5)
    far = [{r[0]: r[1] for r in t.collect()} for t in scaling.fit(m, F.col("value"), tol=1e-6, n_iter=30)[:2]]
    assert all(a == pytest.approx(b, rel=1e-6) for a, b in zip(near, far))


def test_normalised_ks():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 200)) + 4 * np.outer(rng.normal(size=80), rng.normal(size=200))
    s = np.linalg.svd(x, compute_uv=False)
    assert spectrum.normalised_ks(s, 80, 200, 1.0) < 0.05 < spectrum.ks(s * 1.3, 80, 200, 1.0)
    assert spectrum.ks(s[:20], 80, 200, 1.0) <= spectrum.ks(s, 80, 200, 1.0) + 1e-12


@pytest.fixture(scope="module")
def months(spark):
    m = catalog.supplier_month(spark, SF).settled()
    rows, cols = axes(m)
    return m, rows, cols, dense(m.cells, rows, cols)


def query(spark, name):
    return catalog.QUERIES[name](spark, SF)


def test_spectra_of_queries(spark, months):
    m, rows, cols, x = months
    u, w = sinkhorn(x)
    s = np.linalg.svd(np.sqrt(u)[:, None] * x * np.sqrt(w), compute_uv=False)
    sigma = spectrum.noise_scale(s, *sorted(x.shape))
    assert [r["s"] for r in query(spark, "spectrum_scaled").orderBy("component").collect()] == pytest.approx(s.tolist(), abs=1e-5)
    (r,) = query(spark, "mp_rank").collect()
    assert (r["rank"], r["sigma"]) == (spectrum.mp_rank(s, *sorted(x.shape), sigma), pytest.approx(sigma, abs=1e-5))


def test_low_rank_queries(spark, months):
    m, rows, cols, x = months
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    low = lambda k: (u[:, :k] * s[:k]) @ vt[:k]
    got = {r["col_id"]: r for r in query(spark, "low_rank_mean_variance").collect()}
    assert [got[c]["mean"] for c in cols] == pytest.approx(low(3).mean(0).tolist(), abs=1e-4)
    assert [got[c]["variance"] for c in cols] == pytest.approx(low(3).var(0, ddof=1).tolist(), abs=1e-4)
    z = low(2)
    want = np.where(z > np.abs(np.quantile(z, 0.001, axis=0)), z, x)
    assert dense(query(spark, "low_rank_threshold"), rows, cols) == pytest.approx(want, abs=1e-4)
    depth = x.sum(1)
    got = {r["component"]: r["r"] for r in query(spark, "depth_correlation").collect()}
    assert [abs(got[j]) for j in range(3)] == pytest.approx([abs(np.corrcoef(depth, u[:, j])[0, 1]) for j in range(3)], abs=1e-4)
    held = u if len(rows) < len(cols) else vt.T
    got = {(r["component"], r["place"]): r["feature"] for r in query(spark, "top_features_of_components").collect()}
    names = rows if len(rows) < len(cols) else cols
    assert {got[0, p] for p in range(10)} == {str(names[i]) for i in np.argsort(-np.abs(held[:, 0]))[:10]}


def test_fit_queries(spark, months):
    m, rows, cols, x = months
    nodes = fit.lobatto(51)
    kept = x[(x != 0).sum(1) > 1][:, (x != 0).sum(0) > 1]
    sigma, kst = map(np.array, zip(*(fit.local_fit(kept, q) for q in nodes)))
    best = fit.minimise(nodes, kst)
    at = float(np.polynomial.Chebyshev.fit(nodes, sigma, 51, domain=[0, 1])(best))
    got = {r["parameter"]: r["value"] for r in query(spark, "quadratic_parameters").collect()}
    assert got["q"] == pytest.approx(best, abs=1e-3) and got["sigma"] == pytest.approx(at, abs=1e-3)
    want = Numpy(x, (1 - got["q"]) * got["sigma"] ** 2, got["q"] * got["sigma"] ** 2)
    assert dense(query(spark, "denoised_matrix"), rows, cols) == pytest.approx(np.maximum(want.low(), 0), abs=2e-2)
    back = np.maximum(want.low(), 0) / np.sqrt(np.outer(want.u, want.v))
    size = back.sum(1, keepdims=True)
    got = dense(query(spark, "estimator_transform"), rows, cols)
    assert got == pytest.approx(np.divide(back, size, out=np.zeros_like(back), where=size > 0) * np.median(x.sum(1)), rel=2e-2, abs=2e-1)
    ranks = query(spark, "stability_of_rank").collect()
    assert [r["repeat"] for r in ranks] == [0, 1]


def test_predict_queries(spark, months):
    m, rows, cols, x = months
    new = np.array([i % 10 == 3 for i in rows])
    want = Numpy(x[~new])
    u = x.shape[1] / (want.p[0] * x[new] @ want.v)
    y = np.sqrt(u)[:, None] * x[new] * np.sqrt(want.v)
    z = (y @ want.Vt[: want.rank].T / want.s[: want.rank] * want.shrunk()) @ want.Vt[: want.rank]
    assert dense(query(spark, "estimator_predict_rows"), [i for i, n in zip(rows, new) if n], cols) == pytest.approx(np.maximum(z, 0), abs=1e-3)
    assert query(spark, "estimator_predict_columns").where("col_id NOT LIKE '%-02'").count() == 0


def test_subsample_and_stabilise_queries(spark):
    d = catalog.customer_month(spark, SF)
    got = query(spark, "seeded_subsample")
    assert got.exceptAll(d.cells.select(*got.columns) if set(got.columns) <= set(d.cells.columns) else got).count() == 0
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, query(spark, "seeded_subsample").collect()))
    ids = spark.range(50).select(F.col("id"))
    a, b = (sorted(r[0] for r in subsample(ids.repartition(n), "id", 9, 3).collect()) for n in (1, 7))
    assert a == b and len(a) == 9
    assert query(spark, "auto_stabilize").count() > 0


def test_registered_fits_of_this_kind(spark, months):
    """Missing entries, values around the rank, the chosen rank and the table of fits, against NumPy."""
    m, rows, cols, x = months
    s = np.linalg.svd(x, compute_uv=False)
    noise = np.linalg.svd(dense(X.noise_run(m).cells, rows, cols), compute_uv=False)
    assert (np.abs(dense(X.noise_run(m).cells, rows, cols)) == x).all()
    k = max(1, X.choose_rank(s[: X.CHOICE], noise[0], (x**2).sum()))
    u, w, vt = np.linalg.svd(x, full_matrices=False)
    low = (u[:, :k] * w[:k]) @ vt[:k]
    edge = np.abs(np.quantile(low, 0.001, axis=0))
    want = np.where(low > edge, low, np.where(x != 0, x, 0))
    assert dense(query(spark, "low_rank_threshold_chosen"), rows, cols) == pytest.approx(want, abs=1e-4)

    u, v = sinkhorn(x)
    y = np.sqrt(u)[:, None] * x * np.sqrt(v)
    s = np.linalg.svd(y, compute_uv=False)
    rank = spectrum.mp_rank(s, *sorted(x.shape), spectrum.noise_scale(s, *sorted(x.shape)))
    got = {r["component"]: (r["s"], r["signal"]) for r in query(spark, "spectrum_around_rank").collect()}
    assert got and all(got[i] == (pytest.approx(s[i], abs=1e-4), i < rank) for i in got) and set(got) == set(range(max(0, rank - 10), min(len(s), rank + 10)))

    lost = {(r[0], r[1]) for r in m.cells.where(F.pmod(F.xxhash64("row_id", "col_id"), F.lit(10)) == 0).collect()}
    seen = np.array([[(i, j) not in lost for j in cols] for i in rows])
    share = seen.mean()
    p = np.minimum(np.outer(seen.mean(1), seen.mean(0)) / share, 1)
    z = np.where(seen, x, 0)
    var = p * z + (1 - p) * z * z
    u, v = sinkhorn(var, 3000)
    s = np.linalg.svd(np.sqrt(u)[:, None] * z * np.sqrt(v), compute_uv=False)
    sigma = spectrum.noise_scale(s, *sorted(x.shape))
    got = query(spark, "missing_entries_fit").first()
    assert got["observed"] == pytest.approx(share, abs=1e-6) and got["sigma"] == pytest.approx(sigma, rel=1e-4) and got["rank"] == spectrum.mp_rank(s, *sorted(x.shape), sigma)

    table = {r["sample"]: r for r in query(spark, "parameter_table").collect()}
    f = fit.fit(m)
    assert set(table) == {"brand", "month"} and table["month"]["rank"] == f.rank and table["month"]["bhat"] == pytest.approx(f.parameters["bhat"], abs=1e-4)
