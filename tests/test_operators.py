import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from countloom.bundle import CountMatrix
from countloom.functions import elementwise as E
from countloom.operators import filters, fit, marginals, normalise, scaling, spectrum
from countloom.sources import formats, simulate
from countloom.streaming.fold_in import counters, fold_in_stream


def matrix(spark, x):
    x = np.asarray(x, float)
    rows = [(i, j, float(x[i, j])) for i in range(x.shape[0]) for j in range(x.shape[1]) if x[i, j] != 0]
    cells = spark.createDataFrame(rows, "row_id long, col_id long, value double")
    return CountMatrix(cells, spark.range(x.shape[0]).select(F.col("id").alias("row_id")), spark.range(x.shape[1]).select(F.col("id").alias("col_id")))


def dense(cells, shape):
    out = np.zeros(shape)
    for r in cells.collect():
        out[r["row_id"], r["col_id"]] = r["value"]
    return out


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_stabilize_a_staircase(spark):
    """Row i holds the columns below 2 i + 2, so column j the rows from j // 2 on."""
    m = matrix(spark, np.array([[float(j < 2 * i + 2) for j in range(14)] for i in range(7)]))
    got = filters.stabilize(m, 4)
    assert ids(got.obs) == list(range(1, 7)) and ids(got.var) == list(range(8))
    rows = filters.stabilize(m, 4, order="rows_first")
    assert ids(rows.obs) == list(range(1, 7)) and ids(rows.var) == list(range(8))


@pytest.mark.parametrize("seed", range(2))
def test_iterated_stabilize_keeps_its_promise(spark, seed):
    x = np.random.default_rng(seed).integers(0, 2, (10, 10))
    got = filters.stabilize(matrix(spark, x), 4, n_iters=20)
    if got.shape[0] and got.shape[1]:
        assert marginals.nnz(got, 1).agg(F.min("nnz")).first()[0] >= 4
        assert marginals.nnz(got, 0).agg(F.min("nnz")).first()[0] >= 4


def test_nnz_with_empty_lines_and_stored_zeros(spark):
    m = matrix(spark, [[1, 0], [0, 0], [2, 3]])
    m = m.with_cells(m.cells.unionByName(spark.createDataFrame([(1, 1, 0.0)], "row_id long, col_id long, value double")))
    assert [r["nnz"] for r in marginals.nnz(m, 1).orderBy("row_id").collect()] == [1, 0, 2]
    with pytest.raises(ValueError):
        marginals.nnz(m, 2)


def test_sampling_probabilities(spark):
    rows = [(i, j, float("nan") if i == j == 0 else 1.0) for i in range(3) for j in range(2)]
    m = CountMatrix(spark.createDataFrame(rows, "row_id long, col_id long, value double"), spark.range(3).toDF("row_id"), spark.range(2).toDF("col_id"))
    p = {(r["row_id"], r["col_id"]): r["p"] for r in marginals.sampling_probability(m).collect()}
    assert p[0, 0] == pytest.approx(0.4) and p[1, 1] == 1 and max(p.values()) == 1


def test_variance_models(spark):
    x = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    got = [r[0] for r in x.select(E.binomial_variance("x", 2)).collect()]
    assert got == [1.0, 0.0]
    with pytest.raises(ValueError):
        E.binomial_variance("x", 1)
    b, c = E.raw_parameters(*E.hat_parameters(0.3, 1.2))
    assert E.convex_of(*E.from_raw(b, c)) == pytest.approx((0.3, 1.2))


def test_log1p(spark):
    x = np.array([[4, 0, 2, 7], [1, 5, 0, 3]], float)
    got = dense(normalise.log1p(matrix(spark, x), 10.0), x.shape)
    assert got == pytest.approx(np.log(x / x.sum(1, keepdims=True) * 10 + 1))


def test_sinkhorn_and_spectrum(spark):
    m = simulate.counts(spark, 60, 25, rank=2, library=2000.0, seed=3)
    x = dense(m.cells, (60, 25))
    u, v, info = scaling.fit(m, F.col("value"), tol=1e-9)
    y = scaling.scale(m, u, v)
    sq = dense(scaling.scale(m, u, v, root=False).cells, x.shape)
    assert sq.sum(1) == pytest.approx(np.full(60, 25), rel=1e-6) and sq.sum(0) == pytest.approx(np.full(25, 60), rel=1e-6)
    back = dense(scaling.unscale(y, u, v).cells, x.shape)
    assert back == pytest.approx(x)
    f = spectrum.svd(y)
    yd = dense(y.cells, x.shape)
    assert f.s == pytest.approx(np.linalg.svd(yd, compute_uv=False), abs=1e-5)
    assert dense(spectrum.reconstruct(y, f, f.s), x.shape) == pytest.approx(yd, abs=1e-6)
    again = scaling.fold_in(m.cells, F.col("value"), v, 25).join(u.withColumnRenamed("u", "w"), "row_id")
    assert again.agg(F.max(F.abs(F.col("u") - F.col("w")) / F.col("w"))).first()[0] < 1e-9
    r = scaling.fit(m, F.col("value"), tol=1e-7, stop="ratio")
    assert r[2]["error"] < 1e-7
    with pytest.raises(RuntimeError):
        scaling.fit(m, F.col("value"), tol=1e-15, n_iter=1)
    with pytest.raises(ValueError):
        scaling.fit(m.map_values(-F.col("value")), F.col("value"))


def test_planted_rank(spark):
    m = simulate.counts(spark, 300, 100, rank=3, library=20_000.0, seed=1)
    got = fit.fit(m, {"bhat": 1.0, "chat": 0.0})
    assert got.rank == 3 and got.sigma == pytest.approx(1, abs=0.05)
    assert got.denoised().count() > 0


@pytest.mark.parametrize("gamma", [0.1, 0.5, 0.9])
def test_mp_cdf_is_the_integral_of_the_pdf(spark, gamma):
    a, b = E.mp_support(gamma)
    x = np.linspace(a, b, 4001)
    df = spark.createDataFrame([(float(t),) for t in x], "x double").select("x", E.mp_pdf("x", gamma).alias("p"), E.mp_cdf("x", gamma).alias("c")).orderBy("x").toPandas()
    area = np.concatenate(([0], np.cumsum((df.p[1:].to_numpy() + df.p[:-1].to_numpy()) / 2 * np.diff(x))))
    assert np.abs(area - df.c).max() < 1e-3
    assert spectrum.mp_cdf(x, gamma) == pytest.approx(df.c.to_numpy(), abs=1e-9)
    assert float(spectrum.mp_cdf(np.array(spectrum.mp_ppf(0.3, gamma)), gamma)) == pytest.approx(0.3)


@settings(max_examples=30, deadline=None)
@given(st.floats(0.05, 1), st.floats(1.0, 30))
def test_shrinkers_never_raise_a_value(gamma, z):
    t = z * z - gamma - 1
    if z >= 1 + math.sqrt(gamma):
        root = math.sqrt(max(t * t - 4 * gamma, 0))
        assert root / z <= math.sqrt((t + root) / 2) + 1e-9 <= z + 1e-9


def test_filters_validate(spark):
    df = spark.createDataFrame([(1, True), (5, False)], "n int, flag boolean")
    assert filters.range_filter(df, {"n": {"min": 2}}, "flag").count() == 1
    with pytest.raises(KeyError):
        filters.range_filter(df, {"k": {"min": 2}})
    with pytest.raises(ValueError):
        filters.check({"n": {}})
    assert filters.merged({"n": {"min": 1}}, {"n": {"min": None, "max": 3}}) == {"n": {"min": 1, "max": 3}}


def test_sources(spark, tmp_path):
    (tmp_path / "x.mtx").write_text("%%MatrixMarket matrix coordinate real general\n% c\n3 2 2\n1 1 5\n3 2 1.5\n")
    m = formats.read_matrix_market(spark, f"file://{tmp_path}/x.mtx")
    assert m.shape == (3, 2) and sorted(tuple(r) for r in m.cells.collect()) == [(0, 0, 5.0), (2, 1, 1.5)]
    (tmp_path / "t.csv").write_text('"a",,"b"\n1,x,2.5\n2,y,3.5\n')
    t = formats.read_delimited(spark, f"file://{tmp_path}/t.csv")
    assert t.columns == ["a", "column1", "b"] and t.agg(F.sum("b")).first()[0] == 6.0
    m.write(f"file://{tmp_path}/bundle")
    assert CountMatrix.read(spark, f"file://{tmp_path}/bundle").shape == (3, 2)
    path = f"file://{tmp_path}/results"
    rows = spark.createDataFrame([("a", 1)], "k string, n int")
    formats.append_new(rows, path, ["k"])
    assert formats.append_new(rows.unionByName(spark.createDataFrame([("b", 2)], rows.schema)), path, ["k"]).count() == 2
    assert formats.cached(spark, path, lambda: rows).count() == 2


def test_simulation_does_not_depend_on_partitions(spark):
    a = simulate.counts(spark, 20, 10, kind="negative_binomial", c=0.1, seed=5).cells.orderBy("row_id", "col_id").collect()
    b = simulate.counts(spark, 20, 10, kind="negative_binomial", c=0.1, seed=5).cells.repartition(1).orderBy("row_id", "col_id").collect()
    assert a == b


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, [(0, 2.0), (1, 3.0)])], "row_id long, cells array<struct<col_id:long,value:double>>")
    rows.write.parquet(f"{tmp_path}/in")
    v = spark.createDataFrame([(0, 0.5), (1, 2.0)], "col_id long, v double")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = fold_in_stream(stream, v, 2).writeStream.format("memory").queryName("folded").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c1").start()
    q.awaitTermination(120)
    got = spark.table("folded").first()
    assert got["u"] == pytest.approx(2 / 7) and got["cells"][1]["value"] == pytest.approx(3 * math.sqrt(2 / 7) * math.sqrt(2))
    ev = spark.sql("SELECT timestamp'2020-01-01 00:10:00' AS ts, 1L AS user_id, 'a' AS event_type")
    ev.write.parquet(f"{tmp_path}/ev")
    q = counters(spark.readStream.schema(ev.schema).parquet(f"{tmp_path}/ev")).writeStream.format("memory").queryName("counted").outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c2").start()
    q.awaitTermination(120)
    assert spark.table("counted").first()["total"] == 1


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_fold_in_projection_at_both_shapes(spark, scale):
    from countloom.plans import catalog

    m = catalog.supplier_month(spark, f"/root/testdata/{scale}")
    rows, cols = (sorted(x[0] for x in t.select(k).collect()) for t, k in ((m.obs, "row_id"), (m.var, "col_id")))
    x = np.zeros((len(rows), len(cols)))
    for r in m.cells.collect():
        x[rows.index(r["row_id"]), cols.index(r["col_id"])] = r["value"]
    u, v, _ = scaling.fit(m, E.quadratic_variance_2param("value"))
    u, v = {r["row_id"]: r["u"] for r in u.collect()}, {r["col_id"]: r["v"] for r in v.collect()}
    y = np.sqrt([u[i] for i in rows])[:, None] * x * np.sqrt([v[j] for j in cols])
    left, _, right = np.linalg.svd(y, full_matrices=False)
    want = left[:, 0] * np.sign(right[0, np.abs(right[0]).argmax()])
    got = {r["row_id"]: r["score"] for r in catalog.QUERIES["fold_in_projection"](spark, f"/root/testdata/{scale}").collect()}
    assert sorted(got) == [i for i in rows if i % 10 == 3]
    assert list(got.values()) == pytest.approx([want[rows.index(i)] for i in got], abs=2e-5)
