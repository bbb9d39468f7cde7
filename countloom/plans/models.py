"""Queries on variance models, scaling, spectra and normalisations."""

from __future__ import annotations

import math

from pyspark.sql import Window, functions as F

from countloom.functions import elementwise as E
from countloom.operators import normalise, scaling, spectrum
from countloom.plans.catalog import CM, DENSE, SB, SM, UE, UH, customer_month, register, rounded, supplier_brand, supplier_month, user_event, user_hour


@register(SM + " SELECT row_id, col_id, round(0.75 * value + 0.25 * value * value, 6) AS value FROM cells")
def variance_convex(spark, d):
    return rounded(supplier_month(spark, d).map_values(E.quadratic_variance_convex("value", 0.25)).cells, "value")


@register(SM + " SELECT row_id, col_id, round(0.9 * value + 0.05 * value * value, 6) AS value FROM cells")
def variance_2param(spark, d):
    return rounded(supplier_month(spark, d).map_values(E.quadratic_variance_2param("value", 0.9, 0.05)).cells, "value")


@register(UE + " SELECT row_id, col_id, round(abs(value * (k / (k - 1)) - value * value / (k - 1)), 6) AS value FROM cells JOIN (SELECT col_id, sum(value) AS k FROM cells GROUP BY 1) USING (col_id)")
def variance_binomial(spark, d):
    """Counts of draws default to the column sums."""
    m = user_event(spark, d)
    k = m.cells.groupBy("col_id").agg(F.sum("value").alias("k"))
    return rounded(m.cells.join(k, "col_id").select("row_id", "col_id", E.binomial_variance("value", "k").alias("value")), "value")


@register(UE + ", k AS (SELECT row_id, sum(value) AS k FROM cells GROUP BY 1) SELECT row_id, col_id, CASE WHEN k < 2 THEN 0.0 ELSE round((0.5 / k * (value / k) + (1 - 1 / k - 0.5) * (value / k) * (value / k)) / (1 - 1 / k), 6) END AS value FROM cells JOIN k USING (row_id)")
def variance_normalized_binomial(spark, d):
    m = user_event(spark, d)
    k = m.cells.groupBy("row_id").agg(F.sum("value").alias("k"))
    return rounded(m.cells.join(k, "row_id").select("row_id", "col_id", E.normalized_binomial("value", 0.5, "k").alias("value")), "value")


_DC = DENSE + ", r AS (SELECT row_id, avg(value) AS rm FROM dense GROUP BY 1), c AS (SELECT col_id, avg(value) AS cm FROM dense GROUP BY 1), g AS (SELECT avg(value) AS gm FROM dense)"


@register(SM + _DC + " SELECT row_id, col_id, round(value - rm - cm + gm, 6) + 0.0 AS value FROM dense JOIN r USING (row_id) JOIN c USING (col_id) CROSS JOIN g")
def double_center(spark, d):
    return rounded(normalise.double_center(supplier_month(spark, d)), "value")


@register(CM + ", r AS (SELECT row_id, avg(value) AS rm FROM cells GROUP BY 1), c AS (SELECT col_id, avg(value) AS cm FROM cells GROUP BY 1), g AS (SELECT avg(value) AS gm FROM cells) SELECT row_id, col_id, round(value - rm - cm + gm, 6) + 0.0 AS value FROM cells JOIN r USING (row_id) JOIN c USING (col_id) CROSS JOIN g")
def double_center_nonzero(spark, d):
    return rounded(normalise.double_center_nonzero(customer_month(spark, d)), "value")


@register(SM + _DC + " SELECT row_id, col_id, round((value - rm - cm + gm) * (value - rm - cm + gm), 6) AS value FROM dense JOIN r USING (row_id) JOIN c USING (col_id) CROSS JOIN g")
def variance_general(spark, d):
    """The squared doubly centred matrix."""
    x = normalise.double_center(supplier_month(spark, d))
    return rounded(x.withColumn("value", F.col("value") * F.col("value")), "value")


def sinkhorn_sql(n: int) -> str:
    out, u = ", u0 AS (SELECT row_id, CAST(1.0 AS DOUBLE) AS u FROM obs)", "u0"
    for i in range(1, n + 2):
        out += f", v{i} AS (SELECT col_id, any_value(m) / sum(value * u) AS v FROM cells JOIN {u} USING (row_id) CROSS JOIN dims GROUP BY 1), u{i} AS (SELECT row_id, any_value(n) / sum(value * v) AS u FROM cells JOIN v{i} USING (col_id) CROSS JOIN dims GROUP BY 1)"
        u = f"u{i}"
    return out


@register(SM + sinkhorn_sql(3) + " SELECT row_id, col_id, round(value * sqrt(u) * sqrt(v), 6) AS value FROM cells JOIN u4 USING (row_id) JOIN v4 USING (col_id)")
def sinkhorn_unrolled_3(spark, d):
    """Three Sinkhorn iterations on the counts (Poisson variance), and the scaled matrix, as one plan."""
    m = supplier_month(spark, d)
    u, v = scaling.unrolled(m, F.col("value"), 3)
    return rounded(scaling.scale(m, u, v).cells, "value")


@register(SM + sinkhorn_sql(1) + " SELECT row_id, round(u, 6) AS u FROM u2")
def sinkhorn_row_scalers(spark, d):
    return rounded(scaling.unrolled(supplier_month(spark, d), F.col("value"), 1)[0], "u")


@register(SM + sinkhorn_sql(2) + " SELECT row_id, col_id, round(value * sqrt(u) * sqrt(v), 6) AS value FROM cells JOIN u3 USING (row_id) JOIN v3 USING (col_id)")
def scale_transform(spark, d):
    m = supplier_month(spark, d)
    return rounded(scaling.scale(m, *scaling.unrolled(m, F.col("value"), 2)).cells, "value")


@register(SM + " SELECT row_id, col_id, round(value, 6) AS value FROM cells")
def unscale_roundtrip(spark, d):
    m = supplier_month(spark, d)
    s = scaling.unrolled(m, F.col("value"), 1)
    return rounded(scaling.unscale(scaling.scale(m, *s), *s).cells, "value")


@register(SM + sinkhorn_sql(1) + " SELECT row_id, round(any_value(n) / sum(value * v), 6) AS u FROM cells JOIN v2 USING (col_id) CROSS JOIN dims WHERE row_id % 10 = 3 GROUP BY 1")
def fold_in_rows(spark, d):
    """Scalers of new rows from the column scalers of a fit."""
    m = supplier_month(spark, d)
    _, v = scaling.unrolled(m, F.col("value"), 1)
    return rounded(scaling.fold_in(m.cells.where("row_id % 10 = 3"), F.col("value"), v, m.shape[1]), "u")


@register(SM + sinkhorn_sql(1) + " SELECT col_id, round(any_value(m) / sum(value * u), 6) AS v FROM cells JOIN u2 USING (row_id) CROSS JOIN dims WHERE col_id LIKE '1996%' GROUP BY 1")
def fold_in_cols(spark, d):
    m = supplier_month(spark, d)
    u, _ = scaling.unrolled(m, F.col("value"), 1)
    return rounded(scaling.fold_in(m.cells.where("col_id LIKE '1996%'"), F.col("value"), u, m.shape[0], axis=1), "v")


_GRAM = ", g AS (SELECT a.col_id AS i, b.col_id AS j, sum(a.value * b.value) AS value FROM cells a JOIN cells b ON a.row_id = b.row_id GROUP BY 1, 2)"


@register(SB + _GRAM + " SELECT i, j, value FROM g")
def gram_matrix(spark, d):
    return spectrum.gram_pairs(supplier_brand(spark, d))


@register(SB + " SELECT round(sum(value * value), 4) AS trace FROM cells")
def gram_trace(spark, d):
    """The trace of the Gram matrix: the sum of squared singular values."""
    return rounded(spectrum.gram_pairs(supplier_brand(spark, d)).where("i = j").agg(F.sum("value").alias("trace")), "trace", digits=4)


_PLANTED = ", planted AS (SELECT * FROM cells UNION ALL SELECT row_id, 'copy', 3 * value FROM cells WHERE col_id = 'Brand#11'), g AS (SELECT a.col_id AS i, b.col_id AS j, sum(a.value * b.value) AS value FROM planted a JOIN planted b ON a.row_id = b.row_id GROUP BY 1, 2)"


@register(SB + _PLANTED + " SELECT a.i, a.j FROM g a JOIN g x ON x.i = a.i AND x.j = a.i JOIN g y ON y.i = a.j AND y.j = a.j WHERE a.i < a.j AND 1 - a.value * a.value / (x.value * y.value) < 1e-4")
def linearly_dependent_columns(spark, d):
    """Pairs of columns whose cosine is one to 1e-4; a multiple of a column is planted."""
    m = supplier_brand(spark, d)
    copy = m.cells.where("col_id = 'Brand#11'").select("row_id", F.lit("copy").alias("col_id"), (3 * F.col("value")).alias("value"))
    g = spectrum.gram_pairs(m.with_cells(m.cells.unionByName(copy)))
    own = g.where("i = j")
    both = g.where("i < j").join(own.select("i", F.col("value").alias("x")), "i").join(own.select("j", F.col("value").alias("y")), "j")
    return both.where(1 - F.col("value") * F.col("value") / (F.col("x") * F.col("y")) < 1e-4).select("i", "j")


# --- a spectrum that SQL can make: the customers' total prices stand for singular values
_Y = "WITH y AS (SELECT c_custkey AS component, 1 + abs(c_acctbal) / 1000 AS y FROM customer)"
_Z = ", z AS (SELECT component, y, y / sqrt(4.0) AS z FROM y)"
_EDGE = "z >= 1 + sqrt(0.25)"
_T = "(z * z - 0.25 - 1)"
_ROOT = f"sqrt(greatest({_T} * {_T} - 4 * 0.25, 0.0))"
_X = f"sqrt(({_T} + {_ROOT}) / 2)"
_SHRINK = {
    "frobenius": f"{_ROOT} / z",
    "operator": _X,
    "soft": "z - (1 + sqrt(0.25))",
    "hard": "z",
    "nuclear": f"greatest(pow({_X}, 4) - 0.25 - sqrt(0.25) * {_X} * z, 0.0) / ({_X} * {_X} * z)",
}


def _spectrum(spark, d):
    return spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("component"), (1 + F.abs("c_acctbal") / 1000).alias("y"))


for _kind, _sql in _SHRINK.items():

    def _shrink(spark, d, kind=_kind):
        return rounded(_spectrum(spark, d).select("component", E.shrink("y", kind, 4, 0.25).alias("value")), "value")

    register(_Y + _Z + f" SELECT component, CASE WHEN {_EDGE} THEN round(({_sql}) * sqrt(4.0), 6) ELSE 0.0 END AS value FROM z", f"shrink_{_kind}")(_shrink)


@register(_Y + _Z + f" SELECT component, CASE WHEN {_EDGE} THEN round({_X}, 6) ELSE 0.0 END AS value FROM z")
def debias_singular_values(spark, d):
    return rounded(_spectrum(spark, d).select("component", E.debias(F.col("y") / 2.0, 0.25).alias("value")), "value")


@register(_Y + " SELECT CAST(count(*) AS BIGINT) AS rank FROM y WHERE pow(y / sqrt(4.0), 2) > pow(1 + sqrt(0.25), 2)")
def rank_of_spectrum(spark, d):
    return _spectrum(spark, d).where(F.pow(F.col("y") / 2.0, 2) > (1 + math.sqrt(0.25)) ** 2).agg(F.count("*").alias("rank"))


_GRID = "WITH g AS (SELECT p_partkey AS k, p_size / 20.0 AS x FROM part)"
_MPA, _MPB = "pow(1 - sqrt(0.3), 2)", "pow(1 + sqrt(0.3), 2)"


def _grid(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("k"), (F.col("p_size") / 20.0).alias("x"))


@register(_GRID + f" SELECT k, CASE WHEN x > {_MPA} AND x < {_MPB} THEN round(sqrt(({_MPB} - x) * (x - {_MPA})) / (2 * pi() * 0.3 * x), 6) ELSE 0.0 END AS value FROM g")
def mp_pdf_grid(spark, d):
    return rounded(_grid(spark, d).select("k", E.mp_pdf("x", 0.3).alias("value")), "value")


@register(_GRID + f" SELECT k, CASE WHEN x <= {_MPA} THEN 0.0 WHEN x >= {_MPB} THEN 1.0 ELSE round(0.5 + (sqrt(greatest(({_MPB} - x) * (x - {_MPA}), 0.0)) + 1.3 * asin((x - 1.3) / (2 * sqrt(0.3))) - 0.7 * asin(greatest(least((1.3 * x - 0.49) / (2 * sqrt(0.3) * x), 1.0), -1.0))) / (2 * pi() * 0.3), 6) END AS value FROM g")
def mp_cdf_grid(spark, d):
    return rounded(_grid(spark, d).select("k", E.mp_cdf("x", 0.3).alias("value")), "value")


@register(_Y + " , b AS (SELECT least(CAST(floor((y - 1) / 0.5) AS BIGINT), 19) AS bin FROM y) SELECT bin, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY 1")
def histogram_eigs(spark, d):
    b = F.least(F.floor((F.col("y") - 1) / 0.5).cast("long"), F.lit(19).cast("long"))
    return _spectrum(spark, d).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


# --- normalisations

_LIB = ", t AS (SELECT row_id, sum(value) AS total FROM cells GROUP BY 1), s AS (SELECT quantile_cont(total, 0.5) AS target FROM t)"


@register(SM + _LIB + " SELECT row_id, col_id, round(value * target / total, 6) AS value FROM cells JOIN t USING (row_id) CROSS JOIN s")
def library_normalize(spark, d):
    return rounded(normalise.library_normalize(supplier_month(spark, d)), "value")


@register(SM + _LIB + " SELECT row_id, col_id, round(ln(1 + value * target / total), 6) AS value FROM cells JOIN t USING (row_id) CROSS JOIN s")
def log1p_normalize(spark, d):
    return rounded(normalise.log1p(supplier_month(spark, d)), "value")


@register(CM + DENSE + ", s AS (SELECT col_id, avg(value) AS mean, stddev_pop(value) AS sd FROM dense GROUP BY 1) SELECT row_id, col_id, round((value - mean) / CASE WHEN sd < 1e-12 THEN 1 ELSE sd END, 6) + 0.0 AS value FROM dense JOIN s USING (col_id)")
def zscore_columns(spark, d):
    return rounded(normalise.zscore(customer_month(spark, d)), "value")


@register(UE + DENSE + ", r AS (SELECT row_id, sum(value) AS a FROM cells GROUP BY 1), c AS (SELECT col_id, sum(value) AS b FROM cells GROUP BY 1), g AS (SELECT sum(value) AS t FROM cells), x AS (SELECT row_id, col_id, value, a * b / t AS mu FROM dense JOIN r USING (row_id) JOIN c USING (col_id) CROSS JOIN g) SELECT row_id, col_id, round((value - mu) / sqrt(mu + mu * mu / 100), 6) + 0.0 AS value FROM x")
def pearson_residuals(spark, d):
    return rounded(normalise.pearson_residuals(user_event(spark, d)), "value")


@register(CM + ", t AS (SELECT row_id, sum(value) AS total FROM cells GROUP BY 1), f AS (SELECT col_id, count(*) AS df FROM cells GROUP BY 1) SELECT row_id, col_id, round(value / total * ln(1 + m / df), 6) AS value FROM cells JOIN t USING (row_id) JOIN f USING (col_id) CROSS JOIN dims")
def tfidf(spark, d):
    return rounded(normalise.tfidf(customer_month(spark, d)), "value")


_DISP = DENSE + ", s AS (SELECT col_id, avg(value) AS mean, var_samp(value) AS variance FROM dense GROUP BY 1), x AS (SELECT *, variance / mean AS dispersion FROM s WHERE mean > 0)"
_BINS = ", e AS (SELECT unnest(quantile_cont(mean, [" + ", ".join(repr(i / 4) for i in range(1, 4)) + "])) AS edge FROM x), b AS (SELECT x.*, (SELECT count(*) FROM e WHERE edge < x.mean) AS bin FROM x), md AS (SELECT bin, quantile_cont(dispersion, 0.5) AS med FROM b GROUP BY 1), dv AS (SELECT b.*, med, abs(dispersion - med) AS dev FROM b JOIN md USING (bin)), ma AS (SELECT bin, quantile_cont(dev, 0.5) AS mad FROM dv GROUP BY 1)"


@register(SM + _DISP + _BINS + " SELECT col_id, round(dispersion, 6) AS dispersion, CAST(bin AS INTEGER) AS bin, round(coalesce((dispersion - med) / nullif(mad / 0.6744897501960817, 0), 0.0), 4) + 0.0 AS normalized FROM dv JOIN ma USING (bin)")
def normalized_dispersion(spark, d):
    x = normalise.dispersion(supplier_month(spark, d), 4)
    return rounded(rounded(x.select("col_id", "dispersion", "bin", "normalized"), "dispersion"), "normalized", digits=4)


@register(SM + DENSE + ", s AS (SELECT col_id, var_pop(value) AS v FROM dense GROUP BY 1) SELECT col_id, round(v / sum(v) OVER (), 6) AS share FROM s")
def proportional_variance(spark, d):
    m = supplier_month(spark, d)
    n = m.shape[0]
    from countloom.operators.marginals import moments

    v = moments(m, 0).select("col_id", (F.col("variance") * (n - 1) / n).alias("v"))
    return rounded(v.join(F.broadcast(v.agg(F.sum("v").alias("t")))).select("col_id", (F.col("v") / F.col("t")).alias("share")), "share")


@register(UH + ", e AS (SELECT col_id, sqrt(sum(value * value)) AS nrm, sqrt(sum(CASE WHEN row_id % 3 = 0 THEN value * value ELSE 0 END)) AS sub FROM cells GROUP BY 1), t AS (SELECT sqrt(sum(value * value)) AS nrm, sqrt(sum(CASE WHEN row_id % 3 = 0 THEN value * value ELSE 0 END)) AS sub FROM cells) SELECT e.col_id, round((e.sub / t.sub) / (e.nrm / t.nrm), 6) AS energy FROM e CROSS JOIN t")
def relative_energy(spark, d):
    """A subset's share of a component's norm over the component's share in all rows."""
    x = user_hour(spark, d).cells.withColumn("q", F.col("value") * F.col("value"))
    sub = F.sqrt(F.sum(F.when(F.col("row_id") % 3 == 0, F.col("q")).otherwise(0.0)))
    e = x.groupBy("col_id").agg(F.sqrt(F.sum("q")).alias("nrm"), sub.alias("sub"))
    t = x.agg(F.sqrt(F.sum("q")).alias("nrm_t"), sub.alias("sub_t"))
    return rounded(e.join(F.broadcast(t)).select("col_id", ((F.col("sub") / F.col("sub_t")) / (F.col("nrm") / F.col("nrm_t"))).alias("energy")), "energy")


@register(UE + DENSE + " SELECT row_id, col_id, ceil(value / 2) AS value FROM dense")
def fragment_counts(spark, d):
    return user_event(spark, d).densify().select("row_id", "col_id", F.ceil(F.col("value") / 2).cast("double").alias("value"))
