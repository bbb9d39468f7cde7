"""Normalisations of count matrices: each returns cells (or per-column tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from countloom.bundle import CountMatrix
from countloom.operators import ranks
from countloom.operators.marginals import moments, sums


def _with_row_total(m: CountMatrix) -> DataFrame:
    return m.cells.join(m.cells.groupBy("row_id").agg(F.sum("value").alias("total")), "row_id")


def _target(m: CountMatrix, target: float | None) -> DataFrame:
    """One row: the target library size, by default the median of the rows' sums."""
    if target is not None:
        return m.cells.sparkSession.range(1).select(F.lit(float(target)).alias("target"))
    return ranks.quantiles(sums(m, 1), [], "total", [0.5], ["target"], rows=m.shape[0])


def library_normalize(m: CountMatrix, target: float | None = None) -> DataFrame:
    """Every row sums to the target; rows of sum 0 stay null-free at 0."""
    out = _with_row_total(m).join(F.broadcast(_target(m, target)))
    return out.select("row_id", "col_id", F.coalesce(F.try_divide(F.col("value") * F.col("target"), F.col("total")), F.lit(0.0)).alias("value"))


def log1p(m: CountMatrix, target: float | None = None) -> DataFrame:
    return library_normalize(m, target).withColumn("value", F.log1p("value"))


def zscore(m: CountMatrix) -> DataFrame:
    """Column z-scores of the dense matrix, population deviation; constant columns are divided by 1."""
    n = m.shape[0]
    stats = moments(m, 0).select("col_id", "mean", F.sqrt(F.greatest(F.col("variance") * (n - 1) / n, F.lit(0.0))).alias("sd"))
    sd = F.when(F.col("sd") < 1e-12, 1.0).otherwise(F.col("sd"))
    return m.densify().join(stats, "col_id").select("row_id", "col_id", ((F.col("value") - F.col("mean")) / sd).alias("value"))


def pearson_residuals(m: CountMatrix, theta: float = 100.0) -> DataFrame:
    """(x - mu) / sqrt(mu + mu^2 / theta) of the dense matrix, mu from the margins."""
    rows, cols = (sums(m, a).withColumnRenamed("total", f"total_{a}") for a in (1, 0))
    total = m.cells.agg(F.sum("value").alias("grand"))
    mu = F.col("total_1") * F.col("total_0") / F.col("grand")
    dense = m.densify().join(rows, "row_id").join(cols, "col_id").join(F.broadcast(total))
    return dense.select("row_id", "col_id", F.coalesce(F.try_divide(F.col("value") - mu, F.sqrt(mu + mu * mu / theta)), F.lit(0.0)).alias("value"))


def tfidf(m: CountMatrix) -> DataFrame:
    """tf (share of the row) times log(1 + M / df)."""
    n = m.shape[0]
    df = m.cells.where("value <> 0").groupBy("col_id").agg(F.count("*").alias("df"))
    return _with_row_total(m).join(df, "col_id").select("row_id", "col_id", (F.col("value") / F.col("total") * F.log1p(F.lit(float(n)) / F.col("df"))).alias("value"))


def double_center(m: CountMatrix) -> DataFrame:
    """x - row mean - column mean + grand mean of the dense matrix."""
    rows, cols = m.shape
    r = sums(m, 1).select("row_id", (F.col("total") / cols).alias("rm"))
    c = sums(m, 0).select("col_id", (F.col("total") / rows).alias("cm"))
    g = m.cells.agg((F.sum("value") / (rows * cols)).alias("gm"))
    return m.densify().join(r, "row_id").join(c, "col_id").join(F.broadcast(g)).select("row_id", "col_id", (F.col("value") - F.col("rm") - F.col("cm") + F.col("gm")).alias("value"))


def centering(m: CountMatrix) -> tuple[DataFrame, DataFrame, float]:
    """(row_id, rm), (col_id, cm) and the grand mean, zeros counted: what ``double_center`` takes away and ``uncenter`` adds."""
    rows, cols = m.shape
    r = sums(m, 1).select("row_id", (F.col("total") / cols).alias("rm"))
    c = sums(m, 0).select("col_id", (F.col("total") / rows).alias("cm"))
    return r, c, m.cells.agg(F.sum("value") / (rows * cols)).first()[0] or 0.0


def uncenter(cells: DataFrame, means: tuple[DataFrame, DataFrame, float]) -> DataFrame:
    """The inverse of ``double_center`` under the means of the matrix that was fitted; lines without a mean count as zero lines."""
    r, c, g = means
    x = cells.join(r, "row_id", "left").join(c, "col_id", "left")
    return x.select("row_id", "col_id", (F.col("value") + F.coalesce("rm", F.lit(0.0)) + F.coalesce("cm", F.lit(0.0)) - g).alias("value"))


def double_center_nonzero(m: CountMatrix) -> DataFrame:
    """The same on stored non-zeros, with means over non-zeros; zeros stay zeros."""
    x = m.cells.where("value <> 0")
    r = x.groupBy("row_id").agg(F.avg("value").alias("rm"))
    c = x.groupBy("col_id").agg(F.avg("value").alias("cm"))
    g = x.agg(F.avg("value").alias("gm"))
    return x.join(r, "row_id").join(c, "col_id").join(F.broadcast(g)).select("row_id", "col_id", (F.col("value") - F.col("rm") - F.col("cm") + F.col("gm")).alias("value"))


def dispersion(m: CountMatrix, bins: int = 20) -> DataFrame:
    """Dispersion (variance / mean) normalised inside mean bins: (d - median) / (1.4826 * median absolute deviation).

    Bins are equal in width of the mean's rank; a bin without spread gives 0.
    """
    d = moments(m, 0).where("mean > 0").select("col_id", "mean", "variance", (F.col("variance") / F.col("mean")).alias("dispersion"))
    n = m.shape[1]
    cuts = [i / bins for i in range(1, bins)]
    edges = ranks.quantiles(d, [], "mean", cuts, rows=n).select(F.array(*(F.col(f"q{i}") for i in range(1, bins))).alias("edges"))
    binned = d.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col("mean")))).drop("edges")
    med = ranks.quantiles(binned, ["bin"], "dispersion", [0.5], ["med"], rows=n)
    dev = binned.join(med, "bin").withColumn("dev", F.abs(F.col("dispersion") - F.col("med")))
    mad = ranks.quantiles(dev, ["bin"], "dev", [0.5], ["mad"], rows=n)
    spread = F.col("mad") / 0.6744897501960817
    return dev.join(mad, "bin").select("col_id", "mean", "variance", "dispersion", "bin", F.coalesce(F.try_divide(F.col("dispersion") - F.col("med"), spread), F.lit(0.0)).alias("normalized"))


def highly_variable(m: CountMatrix, low: float = 0.0125, high: float = 3.0, least: float = 0.5) -> DataFrame:
    return dispersion(m).where(F.col("mean").between(low, high) & (F.col("normalized") >= least))


METHODS = {"library": library_normalize, "log1p": log1p, "log1p+z": lambda m, **k: zscore(m.with_cells(log1p(m, **k))), "pearson": pearson_residuals, "tfidf": tfidf}


def apply(m: CountMatrix, methods: dict) -> dict[str, DataFrame]:
    """Layers by name; a value may be options of a known method or a callable on the matrix."""
    unknown = [k for k, v in methods.items() if not callable(v) and k not in METHODS]
    if unknown:
        raise ValueError(f"unknown methods: {unknown}")
    return {k: v(m) if callable(v) else METHODS[k](m, **(v or {})) for k, v in methods.items()}
