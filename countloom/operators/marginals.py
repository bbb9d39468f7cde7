"""Sums, counts, means, moments and quality metrics along an axis. Absent cells are zeros unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from countloom.bundle import CountMatrix
from countloom.operators import ranks

AXIS = {0: "col_id", 1: "row_id"}


def _axis(m: CountMatrix, axis: int) -> tuple[str, DataFrame]:
    """Key and table of the axis that remains: 0 sums over rows, 1 over columns."""
    if axis not in AXIS:
        raise ValueError("axis is 0 or 1")
    return AXIS[axis], m.var.select("col_id") if axis == 0 else m.obs.select("row_id")


def _all(found: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return ids.join(found, key, "left").na.fill(0)


def sums(m: CountMatrix, axis: int) -> DataFrame:
    key, ids = _axis(m, axis)
    return _all(m.cells.groupBy(key).agg(F.sum("value").alias("total")), ids, key)


def nnz(m: CountMatrix, axis: int) -> DataFrame:
    """Stored values other than zero (explicit zeros do not count)."""
    key, ids = _axis(m, axis)
    return _all(m.cells.where("value <> 0").groupBy(key).agg(F.count("*").alias("nnz")), ids, key)


def means(m: CountMatrix, axis: int, *, consider_zeros: bool = True) -> DataFrame:
    key, ids = _axis(m, axis)
    if consider_zeros:
        n = m.shape[axis]
        return _all(m.cells.groupBy(key).agg((F.sum("value") / n).alias("mean")), ids, key)
    return _all(m.cells.where("value <> 0").groupBy(key).agg(F.avg("value").alias("mean")), ids, key)


def grand_mean(m: CountMatrix, *, consider_zeros: bool = True) -> Column | float:
    rows, cols = m.shape
    total, stored = m.cells.agg(F.sum("value"), F.count(F.when(F.col("value") != 0, 1))).first()
    return (total or 0.0) / ((rows * cols if consider_zeros else stored) or 1)


def moments(m: CountMatrix, axis: int) -> DataFrame:
    """Mean and sample variance, zeros counted."""
    key, ids = _axis(m, axis)
    n = m.shape[axis]
    agg = m.cells.groupBy(key).agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    mean = F.col("s") / n
    return _all(agg, ids, key).select(key, mean.alias("mean"), ((F.col("q") / n - mean * mean) * n / max(n - 1, 1)).alias("variance"))


def extremes(m: CountMatrix, axis: int) -> DataFrame:
    """Smallest and largest value, implicit zeros among them."""
    key, ids = _axis(m, axis)
    n = m.shape[axis]
    agg = m.cells.groupBy(key).agg(F.count("*").alias("k"), F.min("value").alias("a"), F.max("value").alias("b"))
    some = F.col("k") < n
    return _all(agg, ids, key).select(key, F.when(some, F.least("a", F.lit(0.0))).otherwise(F.col("a")).alias("low"), F.when(some, F.greatest("b", F.lit(0.0))).otherwise(F.col("b")).alias("high"))


def library_size_median(m: CountMatrix) -> DataFrame:
    return ranks.quantiles(sums(m, 1), [], "total", [0.5], ["median_total"], rows=m.shape[0])


def qc(m: CountMatrix, flag: Column) -> DataFrame:
    """Per row: total, detected columns, total in the columns where ``flag`` (of col_id) holds, and its share."""
    part = F.sum(F.when(flag, F.col("value")).otherwise(0.0))
    agg = m.cells.groupBy("row_id").agg(F.sum("value").alias("total"), F.count(F.when(F.col("value") != 0, 1)).alias("detected"), part.alias("subset_total"))
    return _all(agg, m.obs.select("row_id"), "row_id").withColumn("subset_share", F.coalesce(F.try_divide("subset_total", "total"), F.lit(0.0)))


def sampling_shares(m: CountMatrix) -> tuple[DataFrame, DataFrame, float]:
    """(row_id, row_p), (col_id, col_p) and the overall share of observed cells; a cell is unobserved where it holds NaN."""
    rows, cols = m.shape
    lost = m.cells.where(F.isnan("value"))
    r = _all(lost.groupBy("row_id").agg(F.count("*").alias("lost_r")), m.obs.select("row_id"), "row_id").select("row_id", (1 - F.col("lost_r") / cols).alias("row_p"))
    c = _all(lost.groupBy("col_id").agg(F.count("*").alias("lost_c")), m.var.select("col_id"), "col_id").select("col_id", (1 - F.col("lost_c") / rows).alias("col_p"))
    return r, c, 1 - lost.count() / (rows * cols)


def sampling_probability(m: CountMatrix) -> DataFrame:
    """Rank-one observation probabilities of the cells: least(row share * column share / overall share, 1)."""
    r, c, share = sampling_shares(m)
    return m.cells.join(r, "row_id").join(c, "col_id").select("row_id", "col_id", F.least(F.col("row_p") * F.col("col_p") / share, F.lit(1.0)).alias("p"))
