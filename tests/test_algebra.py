"""Arithmetic, assembly, graphs and annotations on small tables with edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from countloom.bundle import CountMatrix
from countloom.operators import algebra, evaluate, normalise
from countloom.sources import modalities


def cells(spark, rows):
    return spark.createDataFrame(rows, "row_id long, col_id long, value double")


def matrix(spark, rows):
    c = cells(spark, rows)
    return CountMatrix(c, c.select("row_id").distinct(), c.select("col_id").distinct())


def test_arithmetic_of_cells_that_one_side_lacks(spark):
    a, b = cells(spark, [(1, 1, 2.0), (1, 2, 3.0)]), cells(spark, [(1, 2, 3.0), (2, 1, -1.0)])
    assert {tuple(r) for r in algebra.add(a, b, 2.0).collect()} == {(1, 1, 2.0), (1, 2, 9.0), (2, 1, -2.0)}
    assert {tuple(r) for r in algebra.subtract(a, b).collect()} == {(1, 1, 2.0), (1, 2, 0.0), (2, 1, 1.0)}
    got = {(r.row_id, r.col_id): (r.equal, r.greater, r.less, r.less_equal) for r in algebra.compare(a, b).collect()}
    assert got == {(1, 1): (False, True, False, False), (1, 2): (True, False, False, True), (2, 1): (False, True, False, False)}
    assert not algebra.all_equal(a, b).first()[0] and algebra.all_equal(a, a).first()[0]
    assert algebra.all_equal(a.limit(0), b.limit(0)).first()[0]


def test_tables_side_by_side(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "id long, p string")
    b = spark.createDataFrame([(2, "n"), (3, "m")], "id long, q string")
    assert {tuple(r) for r in algebra.concat_columns([a, b], "id").collect()} == {(1, "x", None), (2, None, "n"), (3, None, "m")}
    with pytest.raises(ValueError):
        algebra.concat_columns([a, a], "id")
    new = spark.createDataFrame([(1, None, 5), (2, "z", 6), (9, "w", 7)], "id long, p string, k long")
    assert {tuple(r) for r in algebra.updated(a, new, "id").collect()} == {(1, "x", 5), (2, "z", 6)}
    assert {tuple(r) for r in algebra.stack({"l": a, "r": b}).select("source", "id", "q").collect()} == {("l", 1, None), ("l", 2, None), ("r", 2, "n"), ("r", 3, "m")}


def test_split(spark):
    m = matrix(spark, [(1, 1, 1.0), (2, 1, 2.0), (3, 2, 3.0), (4, 2, 4.0)])
    labels = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "row_id long, batch string")
    parts = algebra.split(CountMatrix(m.cells, labels, m.var), "batch")
    assert {k: sorted(tuple(r) for r in p.cells.collect()) for k, p in parts.items()} == {"a": [(1, 1, 1.0), (3, 2, 3.0)], "b": [(2, 1, 2.0)]}
    assert all(p.shape[1] == 2 for p in parts.values())


def test_scale_and_centre(spark):
    m = matrix(spark, [(1, 1, 2.0), (1, 2, 4.0), (2, 1, 3.0)])
    assert sorted(r.value for r in algebra.feature_scale(m).collect()) == [0.0, 0.5, 0.75, 1.0]
    assert algebra.feature_scale(matrix(spark, [(1, 1, 2.0)])).isEmpty()
    back = normalise.uncenter(normalise.double_center(m), normalise.centering(m))
    got = {(r.row_id, r.col_id): r.value for r in back.collect()}
    assert got == pytest.approx({(1, 1): 2.0, (1, 2): 4.0, (2, 1): 3.0, (2, 2): 0.0})


def test_graphs_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(17, 3))
    x[5] = x[4]  # copies
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, values array<double>")
    d2 = ((x[:, None] - x) ** 2).sum(-1)
    order = np.argsort(np.where(np.eye(17) > 0, np.inf, d2), axis=1, kind="stable")
    s2 = d2[np.arange(17), order[:, 2]]
    want = (np.exp(-d2 / s2[:, None]) + np.exp(-d2 / s2)) / 2

    def dense(t, col):
        out = np.zeros((17, 17))
        for r in t.collect():
            out[r.a, r.b] = r[col]
        return out

    w = evaluate.mutual_affinity(evaluate.squared_distances(p, p), 3)
    assert np.allclose(dense(w, "w"), want)
    walk = dense(evaluate.normalized_graph(w, "random_walk"), "p")
    assert np.allclose(walk.sum(1), 1) and np.allclose(walk, want / want.sum(1)[:, None])
    with pytest.raises(ValueError):
        evaluate.normalized_graph(w, "other")
    half = np.zeros((17, 17))
    for i in range(17):
        near = order[i, :4]
        half[i, near] = np.exp(-d2[i, near] / d2[i, order[i, 4]])
    assert np.allclose(dense(evaluate.sparse_affinity(p, 4), "w"), (half + half.T) / 2)


def test_sparse_affinity_of_copies(spark):
    p = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "id long, values array<double>")
    assert {r.w for r in evaluate.sparse_affinity(p, 2).collect()} <= {0.5, 1.0}


def test_assays_and_layers_with_empty_lines(spark):
    m = matrix(spark, [(1, 1, 2.0), (1, 5, 3.0), (2, 5, 1.0)])
    m = CountMatrix(m.cells, spark.createDataFrame([(1,), (2,), (3,)], "row_id long"), m.var)
    o, v = modalities.annotate_paired(m, F.col("col_id") >= 5, F.col("col_id") == 1)
    rows = {r.row_id: (r.total_sites, r.total_peaks, r.total_genes, r.total_UMIs, r.pct_MT_UMIs) for r in o.collect()}
    assert rows == {1: (1, 3.0, 1, 2.0, 1.0), 2: (1, 1.0, 0, 0.0, 0.0), 3: (0, 0.0, 0, 0.0, 0.0)}
    assert {r.col_id: (r.total_cells, r.total_counts) for r in v.collect()} == {1: (1, 2.0), 5: (2, 4.0)}
    obs = spark.createDataFrame([(1, 8.0), (2, 0.0)], "row_id long, total_reads double")
    got = {r.row_id: (r.mapped_reads, r.pct_mapped_reads, r.pct_MT_reads) for r in modalities.annotate_reads(obs, m.cells.where("row_id = 1"), F.col("col_id") == 1).collect()}
    assert got == {1: (5.0, 0.625, 0.4), 2: (0.0, 0.0, 0.0)}


def test_t_quantiles(spark):
    from countloom.functions.elementwise import t_quantile

    known = {1: 12.7062, 2: 4.3027, 4: 2.7764, 5: 2.5706, 10: 2.2281, 30: 2.0423, 120: 1.9799}  # printed tables
    x = spark.createDataFrame([(k,) for k in [0, *known]], "n long").select("n", t_quantile(0.975, F.col("n")).alias("t"))
    got = {r.n: r.t for r in x.collect()}
    assert got.pop(0) is None and got == pytest.approx(known, abs=4e-4)
    y = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("c", None)], "k string, v double")
    rows = {r.k: (r.n, r.mean, r.half_width) for r in evaluate.mean_t_interval(y, ["k"], "v").collect()}
    assert rows["a"] == pytest.approx((2, 2.0, 12.7062), abs=1e-3) and rows["b"] == (1, 5.0, None) and rows["c"] == (0, None, None)


def test_markers(spark):
    from countloom.operators import markers

    wide = spark.createDataFrame([("Cd-3", 1, 0), ("CD19", None, 1), (None, 1, 1)], "gene string, t int, b int")
    w = markers.from_flags(wide, "gene", ["t", "b"])
    assert {tuple(r) for r in w.collect()} == {("CD3", "t"), ("CD19", "b")}
    text = spark.createDataFrame([("cd3", "t: 4.5; nk: 2"), ("X", None), ("cd19", "b|t")], "gene string, said string")
    listed = markers.from_lists(text, "gene", "said")
    assert {tuple(r) for r in listed.collect()} == {("CD3", "t"), ("CD3", "nk"), ("CD19", "b"), ("CD19", "t")}
    assert {tuple(r) for r in markers.combined(listed, [w]).collect()} == {("CD3", "t"), ("CD19", "b")}
    assert markers.combined(w, [listed], how="union").count() == 4
    names = {"T": ["t", "nk"], "B": ["b"]}
    assert {tuple(r) for r in markers.mapped(listed, names).collect()} == {("CD3", "T"), ("CD19", "B"), ("CD19", "T")}
    assert [tuple(r) for r in markers.mapped(listed, names, exclusive=True).collect()] == [("CD3", "T")]
    assert {tuple(r) for r in markers.flags(markers.mapped(listed, names), ["T", "B"]).collect()} == {("CD3", True, False), ("CD19", True, True)}
    for bad in ({}, {"T": []}, {"T": ["t"], "B": ["t"]}):
        with pytest.raises(ValueError):
            markers.mapped(listed, bad)
    with pytest.raises(ValueError):
        markers.combined(listed, how="other")


def test_spread_of_submatrices(spark):
    from countloom.operators import fit, spectrum
    from countloom.sources import simulate

    m = simulate.counts(spark, 40, 20, rank=2, library=400.0, seed=5)
    fits = fit.quadratic_fits(m, side=15, n_subsamples=2, qits=4)
    minima = fit.minimisers(fits).collect()
    got = fit.spread(fit.minimisers(fits)).first()
    assert [r.submatrix for r in minima] == [0, 1]
    assert got.bhat_mean == pytest.approx(np.mean([r.bhat for r in minima])) and got.chat_var == pytest.approx(np.var([r.chat for r in minima]))
    s = spark.range(30).select(F.col("id").cast("int").alias("component"))
    assert {(r.component, r.signal) for r in spectrum.around_rank(s, 3, 5).collect()} == {(i, i < 3) for i in range(8)}


def test_parameter_table(spark):
    from countloom.operators import experiments, fit
    from countloom.sources import simulate

    m = simulate.counts(spark, 30, 12, rank=2, library=400.0, seed=9)

    def signal(matrix, fitted):
        return fitted.rank / 2

    got = experiments.parameter_table({"one": m}, signal, parameters={"bhat": 1.0, "chat": 0.0}).collect()
    f = fit.fit(m, {"bhat": 1.0, "chat": 0.0})
    assert [(r["sample"], r["rows"], r["columns"], r["rank"]) for r in got] == [("one", *m.shape, f.rank)]
    assert got[0].sigma == pytest.approx(f.sigma) and got[0].signal == f.rank / 2
