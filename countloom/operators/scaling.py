"""Bistochastic (Sinkhorn) scaling of a variance estimate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from countloom.bundle import CountMatrix
from countloom.session import cut

#: Longest axis whose vector is kept on the driver and broadcast in the block loop (8 bytes each); beyond it, joins.
VECTOR_LIMIT = 1_000_000
#: Columns whose sums travel together.
CHUNK = 1 << 16


def _targets(m: CountMatrix, row_sum: float | None, col_sum: float | None) -> tuple[float, float]:
    rows, cols = m.shape
    return float(cols if row_sum is None else row_sum), float(rows if col_sum is None else col_sum)


def unrolled(m: CountMatrix, variance: Column, iterations: int, *, row_sum: float | None = None, col_sum: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(row_id, u) and (col_id, v) after a fixed number of iterations, as one declarative plan."""
    r, c = _targets(m, row_sum, col_sum)
    v = m.cells.select("row_id", "col_id", variance.alias("w"))
    u = m.obs.select("row_id", F.lit(1.0).alias("u"))
    for _ in range(iterations + 1):
        cols = v.join(u, "row_id").groupBy("col_id").agg((F.lit(c) / F.sum(F.col("w") * F.col("u"))).alias("v"))
        u = v.join(cols, "col_id").groupBy("row_id").agg((F.lit(r) / F.sum(F.col("w") * F.col("v"))).alias("u"))
    return u, cols


def fit(m: CountMatrix, variance: Column, *, tol: float = 1e-6, n_iter: int = 500, row_sum: float | None = None, col_sum: float | None = None, stop: str = "sums") -> tuple[DataFrame, DataFrame, dict]:
    """(row_id, u), (col_id, v) and {iterations, error}: iterated until row and column sums are within ``tol``.

    One pass over the row blocks an iteration: a task scales its rows and hands on partial column sums; the column vector
    (size-checked) is all that the driver keeps. ``stop="ratio"`` ends when the scalers change by less than ``tol``.
    Raises if negative values occur, if sums are not finite, or if the tolerance is not met.
    """
    m = m.settled()
    spark = m.cells.sparkSession
    r, c = _targets(m, row_sum, col_sum)
    if stop not in ("sums", "ratio"):
        raise ValueError("stop is sums or ratio")
    low = m.cells.agg(F.min("value")).first()[0]
    if low is not None and low < 0:
        raise ValueError("the matrix has negative values")
    held = m.var.select("col_id").limit(VECTOR_LIMIT + 1).toArrow().column("col_id").sort()
    n = len(held)
    if n > VECTOR_LIMIT:
        return _fit_joins(m, variance, r, c, tol, n_iter, stop)
    index = spark.createDataFrame(pa.table({"col_id": held, "j": pa.array(np.arange(n), pa.int32())}))
    cells = m.cells.select("row_id", "col_id", variance.alias("w")).join(F.broadcast(index), "col_id")
    blocks = cells.groupBy("row_id").agg(F.collect_list("j").alias("j"), F.collect_list("w").alias("w"))
    blocks = cut(blocks, "blocks")  # a row is as long as the matrix is wide, at most

    def one_pass(scale: np.ndarray | None) -> np.ndarray:
        """Column sums of the rows scaled by ``scale`` (None: not scaled), added by chunks of the column axis."""
        held = spark.sparkContext.broadcast(scale)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s, out = held.value, np.zeros(n)
            for batch in batches:
                if batch.num_rows:
                    j, w = batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy()
                    lens = batch.column(1).value_lengths().to_numpy()
                    owner = np.repeat(np.arange(len(lens)), lens)
                    out += np.bincount(j, w if s is None else w * (r / np.bincount(owner, w * s[j], len(lens)))[owner], n)
            at = [a for a in range(0, n, CHUNK) if not (out[a : a + CHUNK] == 0).all()]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([out[a : a + CHUNK].tobytes() for a in at], pa.binary())], names=["a", "s"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for a, s in zip(*(x.to_pylist() for x in batch.columns)):
                    total[a] = total.get(a, 0) + np.frombuffer(s)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["a", "s"])

        schema, out = "a long, s binary", np.zeros(n)
        for a, s in blocks.select("row_id", "j", "w").mapInArrow(run, schema).repartition(max(1, min(64, n // CHUNK)), "a").mapInArrow(add, schema).collect():
            out[a : a + CHUNK] += np.frombuffer(s)
        return out

    sums = one_pass(None)
    scale, error, done = c / sums, np.inf, 0
    for done in range(1, n_iter + 1):
        sums = one_pass(scale)
        if not np.isfinite(sums).all():
            raise FloatingPointError("the scaling diverged")
        error = float(np.abs(scale * sums - c).max()) if stop == "sums" else float(np.abs(c / sums / scale - 1).max())
        if error < tol:
            break
        scale = c / sums
    if tol > 0 and error >= tol:
        raise RuntimeError(f"not converged after {done} iterations: {error:.3g}")
    cols = spark.createDataFrame(pa.table({"col_id": held, "v": scale}))
    u = m.cells.select("row_id", "col_id", variance.alias("w")).join(cols, "col_id").groupBy("row_id").agg((F.lit(r) / F.sum(F.col("w") * F.col("v"))).alias("u"))
    return u, cols, {"iterations": done, "error": error}


def _fit_joins(m: CountMatrix, variance: Column, r: float, c: float, tol: float, n_iter: int, stop: str) -> tuple[DataFrame, DataFrame, dict]:
    """The same loop for axes too long for a broadcast: two joins and two sums an iteration, cut each time.

    An iteration's column sums, under the row scalers before it, are what the scalers it makes are the target over: so how far the last
    column scalers were off, or have changed, is told by a join of two iterations' scalers, without another pass over the cells.
    """
    w = cut(m.cells.select("row_id", "col_id", variance.alias("w")), "variance")
    columns = lambda u: cut(w.join(u, "row_id").groupBy("col_id").agg((F.lit(c) / F.sum(F.col("w") * F.col("u"))).alias("v")), "v")
    cols, error, done = columns(m.obs.select("row_id", F.lit(1.0).alias("u"))), float("inf"), 0
    for done in range(1, n_iter + 1):
        u = cut(w.join(cols, "col_id").groupBy("row_id").agg((F.lit(r) / F.sum(F.col("w") * F.col("v"))).alias("u")), "u")
        after = columns(u)
        ratio = F.col("v") / F.col("x")  # column sums over the target, of the scalers before
        off = F.abs(F.lit(c) * ratio - c) if stop == "sums" else F.abs(1 / ratio - 1)
        error = cols.join(after.withColumnRenamed("v", "x"), "col_id").agg(F.max(off)).first()[0]
        if error is None or not np.isfinite(error):
            raise FloatingPointError("the scaling diverged")
        if error < tol:
            break
        cols = after if done < n_iter else cols
    if tol > 0 and error >= tol:
        raise RuntimeError(f"not converged after {done} iterations: {error:.3g}")
    return u, cols, {"iterations": done, "error": error}


def scale(m: CountMatrix, u: DataFrame, v: DataFrame, *, root: bool = True) -> CountMatrix:
    """Cells times the (roots of the) scalers."""
    f = F.sqrt if root else (lambda x: F.col(x))
    cells = m.cells.join(u, "row_id").join(v, "col_id").select("row_id", "col_id", (F.col("value") * f("u") * f("v")).alias("value"))
    return m.with_cells(cells)


def unscale(m: CountMatrix, u: DataFrame, v: DataFrame, *, root: bool = True) -> CountMatrix:
    f = F.sqrt if root else (lambda x: F.col(x))
    cells = m.cells.join(u, "row_id").join(v, "col_id").select("row_id", "col_id", (F.col("value") / (f("u") * f("v"))).alias("value"))
    return m.with_cells(cells)


def fold_in(cells: DataFrame, variance: Column, fixed: DataFrame, total: float, *, axis: int = 0) -> DataFrame:
    """Scalers of new rows (axis 0, ``fixed`` is (col_id, v)) or new columns (axis 1, ``fixed`` is (row_id, u)).

    A row's own cells decide, so new rows may come as a stream.
    """
    key, other, s = ("row_id", "col_id", "v") if axis == 0 else ("col_id", "row_id", "u")
    out = "u" if axis == 0 else "v"
    w = cells.select("row_id", "col_id", variance.alias("w")).join(fixed, other)
    return w.groupBy(key).agg((F.lit(float(total)) / F.sum(F.col("w") * F.col(s))).alias(out))
