"""Filters on annotations and iterative two-axis filters."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from countloom.bundle import CountMatrix
from countloom.operators.marginals import nnz
from countloom.session import cut

Limits = Mapping[str, Mapping[str, float]]


def check(limits: Limits) -> Limits:
    """Every leaf has ``min`` or ``max`` and nothing else."""
    for col, x in limits.items():
        if not x or set(x) - {"min", "max"}:
            raise ValueError(f"{col}: give min, max or both")
    return limits


def merged(base: Limits, own: Limits) -> dict:
    """``own`` over ``base``; None does not override what is there."""
    out = {k: dict(v) for k, v in base.items()}
    for col, x in own.items():
        for k, v in x.items():
            if v is not None or k not in out.get(col, {}):
                out.setdefault(col, {})[k] = v
    return out


def in_range(df: DataFrame, limits: Limits, mask: str | None = None) -> Column:
    """The inclusive range predicate; with ``mask`` it binds only rows where that column is true."""
    ok = F.lit(True)
    for col, x in check(limits).items():
        if col not in df.columns:
            raise KeyError(col)
        for side, at in x.items():
            if at is not None:
                ok = ok & ((F.col(col) >= at) if side == "min" else (F.col(col) <= at))
    return ok if mask is None else ~F.col(mask) | ok


def range_filter(df: DataFrame, limits: Limits, mask: str | None = None) -> DataFrame:
    return df.where(in_range(df, limits, mask))


def iterative_filter(m: CountMatrix, annotate: Callable[[CountMatrix], tuple[DataFrame, DataFrame]], obs: Limits, var: Limits, n_iters: int = 2) -> CountMatrix:
    """Annotate what survives, filter rows, then columns; again up to ``n_iters`` times or until nothing goes."""
    for _ in range(n_iters):
        before = m.shape
        o, v = annotate(m)
        kept = CountMatrix(m.cells, range_filter(o, obs), range_filter(v, var), m.uns)
        kept = CountMatrix(*(cut(t, "filter") for t in (m.submatrix(kept.obs, kept.var).cells, kept.obs, kept.var)), m.uns)
        if 0 in kept.shape:
            raise ValueError("no rows or no columns are left")
        m = kept
        if m.shape == before:
            break
    return m


def _at_least(m: CountMatrix, axis: int, least: int) -> DataFrame:
    return nnz(m, axis).where(F.col("nnz") >= least).drop("nnz")


def stabilize(m: CountMatrix, rows: int, cols: int | None = None, *, order: str = "simultaneous", n_iters: int = 1) -> CountMatrix:
    """Drop rows and columns with fewer non-zeros than their thresholds: both at once, or one after the other."""
    cols = rows if cols is None else cols
    for _ in range(max(1, n_iters)):
        before = m.shape if n_iters > 1 else None
        if order == "simultaneous":
            m = m.submatrix(_at_least(m, 1, rows), _at_least(m, 0, cols))
        elif order == "rows_first":
            m = m.submatrix(rows=_at_least(m, 1, rows))
            m = m.submatrix(cols=_at_least(m, 0, cols))
        elif order == "cols_first":
            m = m.submatrix(cols=_at_least(m, 0, cols))
            m = m.submatrix(rows=_at_least(m, 1, rows))
        else:
            raise ValueError("order is simultaneous, rows_first or cols_first")
        if n_iters > 1:
            m = CountMatrix(cut(m.cells, "stable"), cut(m.obs, "stable"), cut(m.var, "stable"), m.uns)
            if m.shape == before:
                break
    return m


def bound_holds(m: CountMatrix, axis: int, k: int) -> bool:
    """Fewer than ceil(n k / d) of the axis' n lines have d - k or more zeros, d being their length."""
    lines = nnz(m, axis)
    n, d = lines.count(), m.shape[axis]
    zeros = lines.where(F.lit(d) - F.col("nnz") >= d - k).count()
    return zeros < -(-n * k // d)


def auto_stabilize(m: CountMatrix, step: int | None = None, most: int = 1000) -> CountMatrix:
    """Remove the sparsest lines of a failing axis until the bound holds for every k up to half of either axis.

    Without ``step``, as many lines go at once as the worst k needs. Raises if ``most`` rounds do not suffice.
    """
    m = stabilize(m, 1)
    for _ in range(most):
        rows, cols = m.shape
        excess = {axis: e for axis, d in ((1, cols), (0, rows)) if (e := _excess(m, axis, d))}
        if not excess:
            return m
        for axis, e in excess.items():
            key = "row_id" if axis == 1 else "col_id"
            gone = nnz(m, axis).orderBy("nnz", key).limit(step or e)
            m = m.submatrix(rows=m.obs.join(gone, key, "left_anti")) if axis == 1 else m.submatrix(cols=m.var.join(gone, key, "left_anti"))
        m = stabilize(m, 1)
        m = CountMatrix(cut(m.cells, "stable"), cut(m.obs, "stable"), cut(m.var, "stable"), m.uns)
    raise RuntimeError(f"the bound does not hold after {most} rounds")


def _excess(m: CountMatrix, axis: int, d: int) -> int:
    """How many lines have to go so that the bound may hold for all k at once; from the histogram of non-zeros (d rows at most)."""
    hist = dict(nnz(m, axis).groupBy("nnz").count().collect())
    n, below, worst = sum(hist.values()), hist.get(0, 0), 0
    for k in range(1, d // 2 + 1):
        below += hist.get(k, 0)
        if below >= -(-n * k // d):
            worst = max(worst, -(-(below * d - n * k) // (d - k)), 1)
    return min(worst, n)


def common_columns(cells: DataFrame, sample: str) -> DataFrame:
    """Columns that every sample holds."""
    samples = cells.select(sample).distinct().count()
    return cells.groupBy("col_id").agg(F.count_distinct(sample).alias("n")).where(F.col("n") == samples).select("col_id")
