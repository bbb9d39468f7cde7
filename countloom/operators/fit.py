"""The whole fit: quadratic variance, scaling, spectrum, rank, denoising."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from countloom.bundle import CountMatrix, subsample
from countloom.functions.elementwise import convex_of, hat_parameters, quadratic_variance_2param, raw_parameters
from countloom.operators import marginals, ranks, scaling, spectrum
from countloom.session import cut


def lobatto(k: int) -> np.ndarray:
    """k + 1 Chebyshev nodes on [0, 1]."""
    return (1 - np.cos(np.pi * np.arange(k + 1) / k)) / 2


def local_fit(x: np.ndarray, q: float, *, tol: float = 1e-6, n_iter: int = 500) -> tuple[float, float]:
    """(sigma, KS) of a small dense matrix under the convex variance."""
    if x.shape[0] > x.shape[1]:
        x = x.T
    v = (1 - q) * x + q * x * x
    m, n = x.shape
    u = np.ones(m)
    for i in range(n_iter):
        w = m / (v.T @ u)
        u = n / (v @ w)
        if i % 10 == 9 and np.abs(w * (v.T @ u) - m).max() < tol:
            break
    else:
        raise RuntimeError(f"the scaling of a submatrix has not converged after {n_iter} iterations (q = {q:.3g})")
    y = np.multiply(x, np.sqrt(u)[:, None], out=v)
    y *= np.sqrt(w)
    s = np.sqrt(np.maximum(np.linalg.eigvalsh(y @ y.T), 0))  # of the smaller side
    sigma = spectrum.noise_scale(s, m, n)
    return sigma, spectrum.ks(s, m, n, sigma)


def minimise(nodes: np.ndarray, values: np.ndarray) -> float:
    """Where the Chebyshev interpolant on [0, 1] is least: best of a fine grid and its stationary points."""
    p = np.polynomial.Chebyshev.fit(nodes, values, len(nodes) - 1, domain=[0, 1])
    grid = np.linspace(0, 1, 100_000)
    d, dd = p.deriv(), p.deriv(2)
    roots = d.roots()
    inner = [r.real for r in roots if abs(r.imag) < 1e-9 and 0 <= r.real <= 1 and dd(r.real) > 0]
    return float(min([grid[p(grid).argmin()], *inner], key=p))


def submatrix_size(shape: tuple[int, int], size: int | tuple | None = None, *, keep_aspect: bool = False) -> tuple[int, int]:
    """Rows and columns of submatrices: a pair (a missing side follows the other) or the shorter side; no more than there are.

    A side that follows is as long as the other, or, with ``keep_aspect``, in the matrix' own proportion. A shorter side that the
    matrix does not exceed is the whole matrix, as is no size.
    """
    m, n = shape
    like = lambda own, other, given: max(int(own / other * given), 1) if keep_aspect else min(given, own)
    if isinstance(size, (tuple, list)):
        if len(size) != 2:
            raise ValueError("a size is a number or a pair")
        rows, cols = (min(x or 0, most) for x, most in zip(size, shape))
        if rows < 1 and cols < 1:
            return m, n
        rows = rows if rows >= 1 else like(m, n, cols)
        return rows, cols if cols >= 1 else like(n, m, rows)
    short, long = sorted(shape)
    size = int(size or 0)
    if size < 1 or size > short or size == short and not keep_aspect:
        return m, n
    other = like(long, short, size)
    return (other, size) if m > n else (size, other)


def draw(m: CountMatrix, shape: tuple[int, int], seed: int) -> DataFrame:
    """(r, c, value): a seeded submatrix of at most ``shape``, its lines numbered from 0 (a few thousand names, numbered in one task)."""
    lines = []
    for ids, col, n, at in ((m.obs, "row_id", shape[0], "r"), (m.var, "col_id", shape[1], "c")):
        chosen = subsample(ids.select(col), col, n, seed)
        lines.append(chosen.withColumn(at, (F.row_number().over(Window.orderBy(col)) - 1).cast("int")))
    x = m.cells.join(F.broadcast(lines[0]), "row_id").join(F.broadcast(lines[1]), "col_id")
    return x.select("r", "c", "value")


def stable(x: np.ndarray, least: int) -> np.ndarray:
    """Without lines of fewer than ``least`` values, until there are none."""
    while x.size and ((few := ((x != 0).sum(1) < least).any()) or ((x != 0).sum(0) < least).any()):
        x = x[(x != 0).sum(1) >= least] if few else x[:, (x != 0).sum(0) >= least]
    return x


#: Most cells of a submatrix: it is held dense by one task, about three times.
SUBMATRIX_CELLS = 25_000_000


def quadratic_fits(m: CountMatrix, *, side: int | None = 5000, size: int | tuple | None = None, keep_aspect: bool = False, n_subsamples: int = 5, qits: int = 51, seed: int = 42, least: int = 2, tries: int = 10) -> DataFrame:
    """(submatrix, q, sigma, kst): seeded submatrices, each fitted at all nodes by one task that holds it once.

    ``size`` and ``keep_aspect`` as for ``submatrix_size``; without a size, at most ``side`` by ``side``. If that is the whole matrix it is fitted
    once. Lines of fewer than ``least`` values leave a submatrix; one of which nothing is left is drawn again, up to ``tries`` times.
    """
    shape = m.shape
    rows, cols = submatrix_size(shape, (side, side) if size is None else size, keep_aspect=keep_aspect)
    if rows * cols > SUBMATRIX_CELLS:
        raise ValueError(f"submatrices of {rows} x {cols} do not fit a task: say a size")
    wanted = list(range(1 if (rows, cols) == shape or n_subsamples < 1 else n_subsamples))
    if n_subsamples < 1 and shape[0] * shape[1] > SUBMATRIX_CELLS:
        raise ValueError("the whole matrix does not fit a task: say how many submatrices")
    rows, cols = shape if n_subsamples < 1 else (rows, cols)
    nodes = lobatto(qits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:  # cells go into the matrix as they come
            which, r, c, value = (batch.column(i).to_numpy() for i in range(4))
            for k in np.unique(which).tolist():
                at = which == k
                np.add.at(held.setdefault(k, np.zeros((rows, cols))), (r[at], c[at]), value[at])
        for k in sorted(held):
            x = stable(held.pop(k), least)
            if x.size:
                fits = [local_fit(x, float(q)) for q in nodes]
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(nodes), pa.int32()), pa.array(nodes), *(pa.array([f[i] for f in fits]) for i in (0, 1))], names=["submatrix", "q", "sigma", "kst"])

    done, found = [], 0
    for again in range(tries):
        parts = [draw(m, (rows, cols), seed + i + again * n_subsamples).select(F.lit(i).alias("submatrix"), "r", "c", "value") for i in wanted]
        cells = parts[0]
        for part in parts[1:]:
            cells = cells.unionByName(part)
        fits = cut(cells.repartitionById(max(wanted) + 1, F.col("submatrix")).mapInArrow(run, "submatrix int, q double, sigma double, kst double"), "fits")  # a task each
        done.append(fits)
        there = {r[0] for r in fits.select("submatrix").distinct().collect()}
        found += len(there)
        wanted = [i for i in wanted if i not in there]
        if not wanted or (rows, cols) == shape:
            break
    if wanted:
        raise ValueError(f"{len(wanted)} submatrices of {rows} x {cols} keep no line of {least} values")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def minimiser(fits: DataFrame) -> dict:
    """Parameters from the mean over submatrices of the nodes' fits."""
    rows = fits.groupBy("q").agg(F.avg("sigma").alias("sigma"), F.avg("kst").alias("kst")).orderBy("q").collect()
    q, sigma, kst = (np.array([r[k] for r in rows]) for k in ("q", "sigma", "kst"))
    best = minimise(q, kst) if np.ptp(kst) > 1e-12 else minimise(q, np.abs(1 - sigma))
    at = float(np.polynomial.Chebyshev.fit(q, sigma, len(q) - 1, domain=[0, 1])(best))
    bhat, chat = hat_parameters(best, at)
    b, c = raw_parameters(bhat, chat)
    return {"q": best, "sigma": at, "bhat": bhat, "chat": chat, "b": b, "c": c}


def minimisers(fits: DataFrame) -> DataFrame:
    """(submatrix, q, sigma, bhat, chat, b, c): each submatrix's own minimum (a row for each of a few submatrices)."""
    kept = cut(fits, "fits")
    names = sorted(r[0] for r in kept.select("submatrix").distinct().collect())
    rows = [(i, *(float(minimiser(kept.where(F.col("submatrix") == i))[k]) for k in ("q", "sigma", "bhat", "chat", "b", "c"))) for i in names]
    return fits.sparkSession.createDataFrame(rows, "submatrix int, q double, sigma double, bhat double, chat double, b double, c double")


def spread(minima: DataFrame) -> DataFrame:
    """One row: mean and (population) variance over submatrices of bhat and chat; the means are the fit by minimisers."""
    return minima.agg(*(f(c).alias(f"{c}_{n}") for c in ("bhat", "chat") for n, f in (("mean", F.avg), ("var", F.var_pop))))



def shrunk(s: np.ndarray, m: int, n: int, sigma: float, shrinker: str = "frobenius") -> np.ndarray:
    """Optimally shrunk singular values of an m x n matrix, m <= n; those below the edge are 0."""
    z, g = s / (math.sqrt(n) * sigma), m / n
    root = np.sqrt(np.maximum((z * z - g - 1) ** 2 - 4 * g, 0))
    x = np.sqrt(np.maximum((z * z - g - 1 + root) / 2, 0))
    safe = np.where(x > 0, x * x * z, 1)
    kinds = {"frobenius": root / np.where(z > 0, z, 1), "operator": x, "soft": z - 1 - math.sqrt(g), "hard": z, "nuclear": np.maximum(x**4 - g - math.sqrt(g) * x * z, 0) / safe}
    if shrinker not in kinds:
        raise ValueError(f"unknown shrinker {shrinker!r}")
    return np.where(z >= 1 + math.sqrt(g), kinds[shrinker], 0.0) * math.sqrt(n) * sigma


@dataclass
class Observed:
    """Rank-one observation probabilities: (row_id, row_p), (col_id, col_p), and the overall share."""

    rows: DataFrame
    cols: DataFrame
    share: float

    def of_new(self, new: CountMatrix, axis: int, length: int) -> Observed:
        """The same with the shares of new rows (axis 0) or columns (axis 1), whose cells hold NaN where they are missing."""
        key, name = ("row_id", "row_p") if axis == 0 else ("col_id", "col_p")
        own = new.cells.groupBy(key).agg((1 - F.count_if(F.isnan("value")) / length).alias(name))
        return replace(self, rows=own) if axis == 0 else replace(self, cols=own)


def _extended(m: CountMatrix, observed: Observed | None, read_counts: int | DataFrame | None) -> CountMatrix:
    """``m`` with missing cells left out and, beside each value, its observation probability (p) and read count (k), where there are such."""
    cells = m.cells
    if observed is not None:
        cells = cells.where(~F.isnan("value")).join(observed.rows, "row_id").join(observed.cols, "col_id").withColumn("p", F.least(F.col("row_p") * F.col("col_p") / observed.share, F.lit(1.0))).drop("row_p", "col_p")
    if isinstance(read_counts, DataFrame):
        cells = cells.join(read_counts.select("col_id", F.col("counts").cast("double").alias("k")), "col_id")
    return m.with_cells(cells)


def variance_of(p: dict, observed: Observed | None, read_counts: int | DataFrame | None) -> Column:
    """Variance of a cell: binomial with read counts, else quadratic; where entries are missing, of the value times a coin that falls with probability p.

    The parameters describe cells that are surely observed; one of probability p has b p / (1 + c) and (1 + c - p) / (1 + c) for the same b
    and c, which comes to the two below.
    """
    x, scale = F.col("value"), F.lit(float(p.get("scale", 1.0)))
    if isinstance(read_counts, DataFrame):
        return scale * x * (F.col("k") - x) / (F.col("k") - 1)
    bhat, chat = p.get("base", (p["bhat"], p["chat"]))
    if observed is None:
        return scale * quadratic_variance_2param("value", bhat, chat)
    return scale * (bhat * F.col("p") * x + (1 - (1 - chat) * F.col("p")) * x * x)


def sure(p: dict, share: float) -> dict:
    """Parameters fitted where a ``share`` of the entries is observed, as those of full observation; chat is not below 0."""
    bhat, chat = p["bhat"] / share, max(0.0, 1 - (1 - p["chat"]) / share)
    b, c = raw_parameters(bhat, chat)
    return p | {"bhat": bhat, "chat": chat, "b": b, "c": c}


@dataclass
class Fitted:
    """A fit: the counts ``m``, scalers (row_id, u) and (col_id, v), the scaled ``y``, its factors, rank and parameters."""

    m: CountMatrix
    u: DataFrame
    v: DataFrame
    y: CountMatrix
    factors: spectrum.Factors
    sigma: float
    rank: int
    kst: float
    parameters: dict
    observed: Observed | None = None
    read_counts: int | DataFrame | None = None

    def _variance(self) -> Column:
        """The fit's variance of a cell, from its value and what ``_extended`` puts beside it."""
        return variance_of(self.parameters, self.observed, self.read_counts)

    def _values(self, shrinker: str) -> np.ndarray:
        return shrunk(self.factors.s[: self.rank], *sorted(self.m.shape), self.sigma, shrinker)

    def denoised(self, shrinker: str = "frobenius", *, truncate: bool = True) -> DataFrame:
        """Cells of the low-rank estimate in the scaled space, negative ones cut off."""
        cells = spectrum.reconstruct(self.y, self.factors, self._values(shrinker))
        return cells.where("value > 0") if truncate else cells

    def components(self, which: str = "left", shrinker: str = "frobenius") -> DataFrame:
        """(row_id or col_id, values): the principal components with shrunk singular values."""
        w = spectrum.factor(self.y, self.factors, self.rank, 0 if which == "left" else 1)
        return _weighted(w, self._values(shrinker))

    def transform(self, *, denoised: bool = True, counts: bool = True, which: str = "left", unscale: bool = False, library_normalize: bool | float = True, shrinker: str = "frobenius", truncate: bool | float = 0, truncation_axis: int = 0) -> DataFrame:
        """The denoised matrix as cells (zeros are not stored), or its components.

        ``truncate``: 0 or True cuts off what is not positive, a share q what does not exceed the absolute q-quantile of its
        column (``truncation_axis`` 0) or row (1), False nothing. ``unscale`` goes back to the counts' scale;
        ``library_normalize`` then divides rows by their sums, times the median row sum of the counts (or a number).
        """
        if not denoised:
            return self.y.cells
        if not counts:
            return self.components(which, shrinker)
        cells = spectrum.reconstruct(self.y, self.factors, self._values(shrinker))
        return self._finished(cells, self.u, self.v, unscale, library_normalize, truncate, truncation_axis)

    def predict(self, new: CountMatrix, *, axis: int = 0, counts: bool = True, which: str | None = None, unscale: bool = False, library_normalize: bool | float = True, shrinker: str = "frobenius", truncate: bool | float = 0, truncation_axis: int = 0) -> DataFrame:
        """As ``transform``, of new rows (axis 0) over the same columns, or of new columns (axis 1) over the same rows.

        New lines are scaled by the frozen scalers of the other axis and projected on its factors. Rows of factors that
        travel as a broadcast (of the new lines, where those of the other axis are not held) are bounded by FACTOR_BYTES.
        ``which`` says whose components are given: those of the new lines, if not said.
        """
        rows, cols = self.m.shape
        line, other, name = ("row_id", "col_id", "v") if axis == 0 else ("col_id", "row_id", "u")
        r, f = self.rank, self.factors
        fixed = self.v if axis == 0 else self.u
        # the scalers of new lines, under the parameters and the residual noise of the fit
        new = _extended(new, self.observed and self.observed.of_new(new, axis, rows if axis else cols), self.read_counts)
        own = scaling.fold_in(new.cells, self._variance(), fixed, cols if axis == 0 else rows, axis=axis)
        u, v = (own, self.v) if axis == 0 else (self.u, own)
        z = scaling.scale(new, u, v)
        loadings = spectrum.factor(self.y, f, r, 1 - axis)
        w = spectrum._projected(z.cells, line, other, loadings.withColumnRenamed(other, "id"), r, False)
        new_factor = w.select(line, F.transform("w", lambda x, j: F.try_divide(x, F.element_at(F.lit(f.s[:r].tolist()), j + 1))).alias("w"))
        values = self._values(shrinker)
        if not counts:
            return _weighted(new_factor if which in (None, "left" if axis == 0 else "right") else loadings, values)
        if f.transposed == (axis == 1):  # the factors of the other axis are held
            cells = spectrum.outer(new_factor, line, f.v[:, :r] * values, f.names, other)
        else:
            most = spectrum.FACTOR_BYTES // (8 * max(r, 1))
            few = new_factor.limit(most + 1).toArrow()
            if few.num_rows > most:
                raise ValueError(f"more than {most} new lines at once")
            held = few.column("w").combine_chunks().flatten().to_numpy().reshape(-1, r) * values
            cells = spectrum.outer(loadings, other, held, few.column(line).combine_chunks(), line)
        return self._finished(cells, u, v, unscale, library_normalize, truncate, truncation_axis)

    def _finished(self, cells: DataFrame, u: DataFrame, v: DataFrame, unscale: bool, library_normalize: bool | float, truncate: bool | float, truncation_axis: int) -> DataFrame:
        if truncate is not False:
            if truncate in (0, True):
                cells = cells.where("value > 0")
            else:
                key = "col_id" if truncation_axis == 0 else "row_id"
                cells = cut(cells, "low-rank")
                cells = cells.join(ranks.quantiles(cells, [key], "value", [truncate], ["t"]), key).where("value > abs(t)").drop("t")
        if unscale:
            cells = scaling.unscale(self.m.with_cells(cells), u, v).cells
        if library_normalize is not False:
            size = library_normalize
            if library_normalize is True:
                size = ranks.quantiles(self.m.cells.groupBy("row_id").agg(F.sum("value").alias("s")), [], "s", [0.5], rows=self.m.shape[0]).first()[0]
            cells = cut(cells, "low-rank")
            sums = cells.groupBy("row_id").agg(F.sum("value").alias("s"))
            cells = cells.join(sums, "row_id").select("row_id", "col_id", (F.col("value") / F.col("s") * F.lit(float(size))).alias("value"))
        return cells.select("row_id", "col_id", "value")


def _weighted(w: DataFrame, values: np.ndarray) -> DataFrame:
    line = w.columns[0]
    return w.select(line, F.transform("w", lambda x, j: x * F.element_at(F.lit([float(v) for v in values]), j + 1)).alias("values"))


def fit(m: CountMatrix, parameters: dict | None = None, *, k: int | None = None, tol: float = 1e-6, n_iter: int = 500, refit: bool = True, read_counts: int | DataFrame | None = None, **options) -> Fitted:
    """Scale, factorise and rank; without ``parameters`` (bhat, chat) the quadratic variance is fitted first.

    With ``refit`` the noise that is left after scaling (``sigma_residual``) is taken into the parameters and the column
    scalers, so that the scaled noise has unit variance. Cells that hold NaN are missing: they are left out, and the
    variance of the others follows the probability with which a cell is observed (rank one, from rows' and columns' shares); given
    parameters are those of full observation.
    ``read_counts``: the binomial variance of so many reads a cell, one number or a table (col_id, counts), at least 2; nothing is then fitted.
    """
    m = m.settled()
    if isinstance(read_counts, DataFrame):
        read_counts = cut(read_counts.select("col_id", "counts"), "read-counts")
        least = read_counts.agg(F.min("counts")).first()[0]
    else:
        least = read_counts
    if read_counts is not None and (least is None or least < 2):
        raise ValueError("read counts must be at least 2")
    observed = None
    if not m.cells.where(F.isnan("value")).isEmpty():
        rows, cols, share = marginals.sampling_shares(m)
        observed = Observed(cut(rows, "row-shares"), cut(cols, "column-shares"), share)
    held = _extended(m, observed, read_counts)
    held = held if held.cells is m.cells else held.settled()
    if read_counts is not None:
        one = 2.0 if isinstance(read_counts, DataFrame) else float(read_counts)
        p = {"bhat": one / (one - 1), "chat": -1 / (one - 1), "c": None if isinstance(read_counts, DataFrame) else -1 / one, "b": 1.0}
    else:
        p = parameters or minimiser(quadratic_fits(held, **options))
        p = sure(p, observed.share) if observed and not parameters else p
    u, v, _ = scaling.fit(held, variance_of(p, observed, read_counts), tol=tol, n_iter=n_iter)
    u, v = cut(u, "u"), cut(v, "v")
    y = m.with_cells(cut(scaling.scale(held, u, v).cells, "scaled"))
    f, sigma, rank, kst = spectrum.spectrum_of(y, k)
    if isinstance(read_counts, DataFrame):  # each column has parameters of its own
        p = {"bhat": None, "chat": None, "b": 1.0, "c": None, "sigma_residual": sigma}
        if refit:
            p["scale"] = sigma * sigma
    else:
        q, before = convex_of(p["bhat"], p["chat"])
        p = p | {"q": q, "sigma": before, "sigma_residual": sigma}
        if refit:
            p |= {"base": (p["bhat"], p["chat"]), "scale": sigma * sigma}
            bhat, chat = hat_parameters(q, before * sigma)
            b, c = raw_parameters(bhat, chat)
            p |= {"sigma": before * sigma, "bhat": bhat, "chat": chat, "b": b, "c": c}
    if refit:
        v = v.withColumn("v", F.col("v") / float(sigma * sigma))
        y = y.map_values(F.col("value") / float(sigma))
        f, sigma = replace(f, s=f.s / sigma), 1.0
    return Fitted(m if observed is None else m.with_cells(held.cells.select("row_id", "col_id", "value")), u, v, y, f, sigma, rank, kst, p, observed, read_counts)
