"""Queries that iterate or call dense kernels: rows are checked by invariants and NumPy in the tests."""

from __future__ import annotations


from pyspark.sql import functions as F

from countloom.functions.elementwise import quadratic_variance_2param
from countloom.operators import fit as fitting, scaling, spectrum
from countloom.plans.catalog import SM, register, rounded, supplier_month
from countloom.plans.models import sinkhorn_sql


@register(SM + sinkhorn_sql(14) + " SELECT row_id, col_id, round(value * sqrt(u) * sqrt(v), 3) AS value FROM cells JOIN u15 USING (row_id) JOIN v15 USING (col_id)")
def sinkhorn_converged(spark, d):
    """Counts scaled until the sums meet their targets; the SQL iterates fifteen times, which is past convergence."""
    m = supplier_month(spark, d)
    u, v, _ = scaling.fit(m, F.col("value"), tol=1e-8)
    return rounded(scaling.scale(m, u, v).cells, "value", digits=3)


def _scaled(spark, d):
    m = supplier_month(spark, d)
    u, v, _ = scaling.fit(m, F.col("value"))
    return m, scaling.scale(m, u, v)


@register()
def spectrum_scaled(spark, d):
    """Singular values and scaled eigenvalues of the scaled counts."""
    m, y = _scaled(spark, d)
    f, sigma, _, _ = spectrum.spectrum_of(y)
    large = max(m.shape)
    rows = [(i, round(float(s), 6), round(float(s * s / (large * sigma * sigma)), 6)) for i, s in enumerate(f.s)]
    return spark.createDataFrame(rows, "component int, s double, eigenvalue double")


@register()
def mp_rank(spark, d):
    m, y = _scaled(spark, d)
    _, sigma, rank, kst = spectrum.spectrum_of(y)
    row = (rank, round(sigma, 6), round(kst, 6))
    return spark.createDataFrame([row], "rank int, sigma double, ks double")


@register(
    SM + ", g AS (SELECT sum(a.value * b.value) AS x FROM cells a JOIN cells b ON a.row_id = b.row_id GROUP BY a.col_id, b.col_id), e AS (SELECT sum(value * value) AS e FROM cells)"
    " SELECT CAST(any_value(least(m, n)) AS BIGINT) AS n_values, round(any_value(e), 2) AS energy, round(sum(x * x) / (any_value(e) * any_value(e)), 7) AS concentration FROM g, e, dims"
)
def spectrum_energy(spark, d):
    """The sums of the squares and of the fourth powers of the singular values, which the Gram matrix tells as well."""
    f = spectrum.svd(supplier_month(spark, d))
    squares = f.s**2
    return spark.createDataFrame([(len(f.s), round(float(squares.sum()), 2), round(float((squares**2).sum() / squares.sum() ** 2), 7))], "n_values long, energy double, concentration double")


@register()
def quadratic_fit(spark, d):
    """Fitted variance per submatrix and node."""
    return rounded(fitting.quadratic_fits(supplier_month(spark, d)), "sigma", "kst", digits=5)


@register()
def quadratic_parameters(spark, d):
    p = fitting.minimiser(fitting.quadratic_fits(supplier_month(spark, d)))
    return spark.createDataFrame([(k, round(v, 5)) for k, v in p.items()], "parameter string, value double")


@register()
def denoised_matrix(spark, d):
    """The low-rank estimate of the scaled counts."""
    f = fitting.fit(supplier_month(spark, d))
    return rounded(f.denoised(), "value", digits=5)


def _left_scores(m, new):
    """(row_id, score): rows ``new`` on the leading left component, by the scalers and the right factor of ``m``."""
    u, v, _ = scaling.fit(m, quadratic_variance_2param("value"))
    y = scaling.scale(m, u, v)
    f = spectrum.svd(y)
    folded = scaling.fold_in(new, quadratic_variance_2param("value"), v, m.shape[1])
    z = new.join(folded, "row_id").join(v, "col_id").select("row_id", "col_id", (F.col("value") * F.sqrt("u") * F.sqrt("v")).alias("z"))
    w = spectrum.right_factor(y, f, 0).withColumn("w", F.col("w") / float(f.s[0]))
    return z.join(w, "col_id").groupBy("row_id").agg(F.sum(F.col("z") * F.col("w")).alias("score"))


@register()
def fold_in_projection(spark, d):
    """Left scores of new rows from frozen scalers and right factors."""
    m = supplier_month(spark, d)
    return rounded(_left_scores(m, m.cells.where("row_id % 10 = 3")), "score", digits=5)


_POISSON = {"bhat": 1.0, "chat": 0.0}


@register()
def spectrum_around_rank(spark, d):
    """The singular values next to the rank's edge, and the side each is on."""
    _, y = _scaled(spark, d)
    f, _, rank, _ = spectrum.spectrum_of(y)
    values = spark.createDataFrame([(i, round(float(s), 6)) for i, s in enumerate(f.s)], "component int, s double")
    return spectrum.around_rank(values, rank)


@register()
def missing_entries_fit(spark, d):
    """The rank and the noise where a tenth of the stored cells, told by a hash, is missing."""
    m = supplier_month(spark, d)
    lost = F.pmod(F.xxhash64("row_id", "col_id"), F.lit(10)) == 0
    f = fitting.fit(m.map_values(F.when(lost, F.lit(float("nan"))).otherwise(F.col("value"))), {"bhat": 1.0, "chat": 0.0})
    row = (f.rank, round(f.parameters["sigma_residual"], 6), round(f.observed.share, 6), round(float(f.kst), 6))
    return spark.createDataFrame([row], "rank int, sigma double, observed double, ks double")


@register()
def estimator_transform(spark, d):
    """The denoised counts: unscaled, and with rows brought to the median row sum."""
    return rounded(fitting.fit(supplier_month(spark, d)).transform(unscale=True), "value", digits=4)


@register()
def estimator_predict_rows(spark, d):
    """Suppliers that the fit has not seen, denoised by its scalers and right factors."""
    m = supplier_month(spark, d)
    new = m.submatrix(rows=m.obs.where("row_id % 10 = 3"))
    old = m.submatrix(rows=m.obs.where("row_id % 10 <> 3"))
    return rounded(fitting.fit(old, _POISSON).predict(new, library_normalize=False), "value", digits=4)


@register()
def estimator_predict_columns(spark, d):
    """Months that the fit has not seen, denoised by its scalers and left factors."""
    m = supplier_month(spark, d)
    new, old = (m.submatrix(cols=m.var.where(f"{no} (col_id LIKE '%-02')")) for no in ("", "NOT"))
    return rounded(fitting.fit(old, _POISSON).predict(new, axis=1, library_normalize=False), "value", digits=4)
