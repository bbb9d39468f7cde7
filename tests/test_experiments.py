import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from countloom.operators import evaluate, experiments as X, fit, spectrum
from countloom.plans import catalog
from countloom.sources import modalities, simulate


@pytest.fixture(scope="module")
def m(spark):
    return simulate.counts(spark, 30, 12, rank=2, library=400.0, seed=9)


def dense(m):
    out = np.zeros((30, 12))
    for r in m.cells.collect():
        out[r["row_id"], r["col_id"]] = r["value"]
    return out


def test_elements_and_scores(spark, m):
    x, f = dense(m), spectrum.svd(m)
    assert X.element(m, f, 3, 4) == pytest.approx(x[3, 4], abs=1e-6)
    with pytest.raises(IndexError):
        X.element(m, f, 3, 99)
    with pytest.raises(IndexError):
        X.element(m, f, 99, 3)
    with pytest.raises(ValueError):
        X.element(m, f, 3, 4, rank=13)
    got = {r["row_id"]: r["values"] for r in X.scores(m, 2).collect()}
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    assert [abs(got[i][0]) for i in range(30)] == pytest.approx(np.abs(u[:, 0] * s[0]).tolist(), abs=1e-6)
    flipped = {r["row_id"]: r["values"] for r in X.scores(m.transpose(), 1).collect()}
    assert sum(v[0] ** 2 for v in flipped.values()) == pytest.approx(s[0] ** 2)
    top = X.top_features(f, spark, 3).where("component = 0").orderBy("place").collect()
    assert [r["feature"] for r in top] == [str(f.names[i]) for i in np.argsort(-np.abs(f.v[:, 0]))[:3]]


def test_spaces():
    a = np.eye(5)[:, :2]
    assert X.grassmann(a, a) == pytest.approx(0) and X.grassmann(a, np.eye(5)[:, 2:4]) == pytest.approx(math.sqrt(2) * math.pi / 2)
    d, b = X.affine_coordinates(np.random.default_rng(0).normal(size=(40, 6)) + 3, 2)
    y = X.stiefel(d, b)
    assert y.T @ y == pytest.approx(np.eye(3), abs=1e-9)


def test_rank_and_sigma():
    s = np.array([9.0, 5, 2, 1, 0.5])
    for rank in range(5):
        assert spectrum.mp_rank(s, 5, 20, X.rank_to_sigma(s, rank, 5, 20)) == rank
    rng = np.random.default_rng(1)
    eigs = np.linalg.svd(rng.normal(size=(200, 400)), compute_uv=False) ** 2 / 400
    assert X.density_loss(eigs, 0.5) < 1e-3 < X.density_loss(eigs * 2, 0.5)


def test_modalities(spark, m):
    o, v = modalities.EXPRESSION.annotate(m, F.col("col_id") < 3)
    x = dense(m)
    got = {r["row_id"]: r for r in o.collect()}
    assert [got[i]["total_UMIs"] for i in range(30)] == x.sum(1).tolist()
    assert [got[i]["pct_MT_UMIs"] for i in range(30)] == pytest.approx((x[:, :3].sum(1) / x.sum(1)).tolist())
    assert modalities.PAIRED_EXPRESSION.limits()[0] == {"total_genes": {"min": 100}}
    data = modalities.Dataset("d", modalities.GENOTYPES, {"total_SNPs": {"min": 6}}, hidden=("z",))
    kept = data.filter({"a": m, "b": m.submatrix(cols=m.var.where("col_id < 11"))})
    assert kept["a"].var.count() == kept["b"].var.count() <= 11
    with pytest.raises(ValueError):
        modalities.Dataset("d", modalities.GENOTYPES, {"total_SNPs": {"min": 99}}).filter({"a": m})


def test_contacts_count_cells(spark, m):
    o, v = modalities.CONTACTS.annotate(m)
    x = dense(m)
    got = {r["row_id"]: r["total_contacts"] for r in o.collect()}
    assert [got[i] for i in range(30)] == (x != 0).sum(1).tolist()
    got = {r["col_id"]: r["total_contacts"] for r in v.collect()}
    assert [got[j] for j in range(12)] == (x != 0).sum(0).tolist()


def test_two_sided_p(spark):
    from countloom.functions.elementwise import two_sided

    z = [0.0, 0.1, 1.0, -1.96, 3.0, 6.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in z], "z double").select(two_sided("z")).collect()]
    assert got == pytest.approx([math.erfc(abs(x) / math.sqrt(2)) for x in z], abs=2e-7)


def test_classifier_on_separated_points(spark):
    rows = [(i, [float(i % 2 * 10), float(i % 7) / 10], i % 2) for i in range(60)]
    p = spark.createDataFrame(rows, "id long, values array<double>, label int")
    assert X.classifier(p, [1, 5]).agg(F.min("accuracy")).first()[0] == 1.0


def test_regress_out_leaves_no_slope(spark, m):
    c = m.cells.groupBy("row_id").agg(F.sum("value").alias("c"))
    r = X.regress_out(m, c).join(c, "row_id").groupBy("col_id").agg(F.covar_samp("value", "c").alias("s"))
    assert r.agg(F.max(F.abs("s"))).first()[0] < 1e-6


def test_regress_out_of_several(spark, m):
    """Residuals as NumPy's least squares, also where covariates depend on each other."""
    rows, cols = (sorted(r[0] for r in t.collect()) for t in (m.obs.select("row_id"), m.var.select("col_id")))
    rng = np.random.default_rng(0)
    c = {r: [float(v) for v in rng.normal(size=2)] for r in rows}
    c = {r: [a, b, 3 * a - b, 7.0] for r, (a, b) in c.items()}
    x = {(r[0], r[1]): r[2] for r in m.cells.select("row_id", "col_id", "value").collect()}
    y = np.array([[x.get((i, j), 0.0) for j in cols] for i in rows])
    design = np.array([[1.0, *c[i]] for i in rows])
    want = y - design @ np.linalg.lstsq(design, y, rcond=None)[0]
    got = X.regress_out(m, spark.createDataFrame([(i, *c[i]) for i in rows], "row_id long, a double, b double, d double, e double")).collect()
    at = {k: i for i, k in enumerate(rows)}, {k: i for i, k in enumerate(cols)}
    assert len(got) == y.size and all(r["value"] == pytest.approx(want[at[0][r["row_id"]], at[1][r["col_id"]]], abs=1e-6) for r in got)


@pytest.mark.parametrize("planted", [0, 1, 7, 20])
def test_choose_rank(planted):
    rng = np.random.default_rng(planted)
    x = rng.normal(size=(300, 200))
    x += (rng.normal(size=(300, planted)) * np.linspace(2, 1, max(planted, 1))[:planted]) @ rng.normal(size=(planted, 200))
    s, noise = (np.linalg.svd(z, compute_uv=False) for z in (x, x * rng.choice([-1, 1], x.shape)))
    assert X.choose_rank(s, noise[0], (x**2).sum()) == planted
    assert X.choose_rank(np.zeros(3), 0.0, 0.0) == 0


@pytest.mark.parametrize("planted", [1, 7, 20])
def test_gap_rank(planted):
    noise = 30 - 0.1 * np.arange(100 - planted) + np.random.default_rng(1).uniform(0, 0.02, 100 - planted)
    s = np.concatenate((40 + 2.0 * np.arange(planted)[::-1], noise))
    assert X.gap_rank(s) == planted and X.gap_rank(noise) == 0
    with pytest.raises(ValueError):
        X.gap_rank(s[:3])


def votes(ids, x, labels, fold, ks):
    """(k, fold): accuracy by brute force, ties by id."""
    hits = {}
    for i in range(len(ids)):
        train = np.flatnonzero(fold != fold[i])
        d = ((x[train] - x[i]) ** 2).T.sum(0)
        near = labels[train[np.lexsort((ids[train], d))]]
        for k in ks:
            hits.setdefault((k, int(fold[i])), []).append(np.bincount(near[:k]).argmax() == labels[i])
    return {key: np.mean(h) for key, h in hits.items()}


def mean_silhouettes(x, labels):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    out = []
    for i, c in enumerate(labels):
        own = d[i, labels == c].sum() / max(1, (labels == c).sum() - 1)
        other = min(d[i, labels == k].mean() for k in set(labels.tolist()) - {c})
        out.append(0.0 if (labels == c).sum() == 1 or max(own, other) == 0 else (other - own) / max(own, other))
    return np.array(out)


def folds(points):
    return {r["id"]: r["f"] for r in points.select("id", F.pmod(F.xxhash64(F.lit(34), "id"), F.lit(5)).alias("f")).collect()}


@pytest.mark.parametrize("size", [7, 4096])
def test_blocks_are_brute_force(spark, monkeypatch, size):
    """Copies, a point alone in its class, and blocks of few points."""
    monkeypatch.setattr(evaluate, "QUERIES", size)
    monkeypatch.setattr(evaluate, "POINTS", 2 * size)
    rng = np.random.default_rng(3)
    x, labels = rng.normal(size=(60, 4)) + 100, rng.integers(0, 3, 60)
    x[20:40], labels[59] = x[20], 3
    p = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, labels))], "id long, values array<double>, label int")
    f = folds(p)
    want = votes(np.arange(60), x, labels, np.array([f[i] for i in range(60)]), [1, 3, 50])
    assert {(r["k"], r["fold"]): r["accuracy"] for r in X.classifier(p, [1, 3, 50]).collect()} == pytest.approx(want)
    got = {r["a"]: r["silhouette"] for r in evaluate.silhouette_of_all(p).collect()}
    assert [got[i] for i in range(60)] == pytest.approx(mean_silhouettes(x, labels).tolist(), abs=1e-9)


def test_registered_scores_take_all_points(spark):
    sf = "/root/testdata/sf0.001"
    e = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").select(F.col("vec_id").alias("id"), "embedding", "label")
    rows = e.collect()
    ids, x, labels = np.array([r["id"] for r in rows]), np.array([r["embedding"] for r in rows], float), np.array([r["label"] for r in rows])
    f = folds(e)
    want = votes(ids, x, labels, np.array([f[i] for i in ids]), [2, 5, 10, 20, 40, 80, 160])
    assert {(r["k"], r["fold"]): r["accuracy"] for r in catalog.QUERIES["knn_classifier"](spark, sf).collect()} == pytest.approx(want, abs=1e-6)
    got = {r["a"]: r["silhouette"] for r in catalog.QUERIES["silhouette_of_all"](spark, sf).collect()}
    assert [got[i] for i in ids] == pytest.approx(mean_silhouettes(x, labels).tolist(), abs=1e-5)
    m = catalog.supplier_month(spark, sf)
    s = {r["row_id"]: r["values"] for r in X.scores(m, 4).collect()}
    nation = {r["s_suppkey"]: r["s_nationkey"] % 4 for r in spark.read.parquet(f"{sf}/supplier.parquet").collect()}
    y, c = np.array([s[i] for i in s]), np.array([nation[i] for i in s])
    got = {r["k"]: r["silhouette"] for r in catalog.QUERIES["silhouette_by_components"](spark, sf).collect()}
    assert got == pytest.approx({k: mean_silhouettes(y[:, :k], c).mean() for k in (2, 4)}, abs=1e-5)


def test_variance_is_fitted_over_the_whole_matrix(spark, monkeypatch):
    """Nodes of the registered fit, as the reference has them, over all suppliers; later steps fit when nothing is given."""
    sf = "/root/testdata/sf0.01"  # 100 suppliers
    m = catalog.supplier_month(spark, sf)
    rows = catalog.QUERIES["quadratic_fit"](spark, sf).collect()
    assert sorted(r["q"] for r in rows) == pytest.approx(fit.lobatto(51).tolist())
    x = m.cells.toPandas().pivot_table(index="row_id", columns="col_id", values="value", fill_value=0.0).to_numpy(float)
    x = x[(x != 0).sum(1) > 1][:, (x != 0).sum(0) > 1]
    for r in sorted(rows, key=lambda r: r["q"])[::17]:
        assert (r["sigma"], r["kst"]) == pytest.approx(fit.local_fit(x, r["q"]), abs=2e-5)
    seen = []
    monkeypatch.setattr(fit, "minimiser", lambda fits: seen.append(fits) or {"bhat": 1.0, "chat": 0.0})
    catalog.QUERIES["denoised_matrix"](spark, sf)
    assert len(seen) == 1
    X.stability(m, repeats=1)
    assert len(seen) == 2
