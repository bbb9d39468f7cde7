"""Gram matrices, spectra, the Marchenko-Pastur rank, and reconstruction."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from countloom.bundle import CountMatrix
from countloom.operators import lanczos
from countloom.session import cut

#: Largest small axis for a Gram matrix on the driver (200 MB); larger ones take products with few vectors (lanczos).
GRAM_LIMIT = 5000
#: Most bytes of a factor (small axis x components) that the driver and a broadcast hold.
FACTOR_BYTES = 256 << 20
#: Random starts times length of the small axis, for the density of eigenvalues: its error is about half the root's inverse.
STARTS = 160_000
#: Cells that a kernel makes or takes at once.
CELLS = 1 << 20


def gram_pairs(m: CountMatrix) -> DataFrame:
    """(i, j, value): sums over rows of products of columns, as a join; for few columns."""
    a = m.cells.select("row_id", F.col("col_id").alias("i"), F.col("value").alias("x"))
    b = m.cells.select("row_id", F.col("col_id").alias("j"), F.col("value").alias("y"))
    return a.join(b, "row_id").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("value"))


def names_of(m: CountMatrix) -> pa.Array:
    """The columns' names, sorted; at most FACTOR_BYTES / 8."""
    most = FACTOR_BYTES // 8
    held = m.var.select("col_id").limit(most + 1).toArrow().column("col_id").combine_chunks()
    if len(held) > most:
        raise ValueError(f"the small axis has more than {most} entries")
    return held.sort()


def sparse_rows(m: CountMatrix, names: pa.Array) -> DataFrame:
    """(row_id, j, x): the stored cells of each row, with the places of their columns in ``names``."""
    index = m.cells.sparkSession.createDataFrame(pa.table({"col_id": names, "j": pa.array(np.arange(len(names)), pa.int32())}))
    cells = m.cells.join(F.broadcast(index), "col_id")
    return cells.groupBy("row_id").agg(F.collect_list("j").alias("j"), F.collect_list("value").alias("x"))


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(row ids, row of each cell, column of each cell, value) of rows with about CELLS cells together."""
    lens = batch.column(1).value_lengths().to_numpy()
    group = np.cumsum(lens) // CELLS
    edge = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(lens)]
    for a, b in zip(edge, edge[1:]):
        if a < b:
            part = batch.slice(a, b - a)
            yield part.column(0), np.repeat(np.arange(b - a), lens[a:b]), part.column(1).flatten().to_numpy(), part.column(2).flatten().to_numpy()


def _times(owner: np.ndarray, j: np.ndarray, x: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Sparse rows times ``v``, column of v by column."""
    return np.stack([np.bincount(owner, x * v[j, k], n) for k in range(v.shape[1])], axis=1)


def _summed(parts: DataFrame, d: int, width: int) -> np.ndarray:
    """Partial sums (i, values: a line of the result) added by line."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(v)
                out[i] = out[i] + x if i in out else x
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array([x.tobytes() for x in out.values()], pa.binary())], names=["i", "values"])

    out, added = np.zeros((d, width)), parts.repartition("i").mapInArrow(add, "i long, values binary")
    if width <= 64:  # a block of vectors comes at once
        lines = added.toArrow()
        if lines.num_rows:
            out[lines.column("i").to_numpy()] = np.frombuffer(b"".join(lines.column("values").to_pylist())).reshape(-1, width)
        return out
    for i, v in added.toLocalIterator():
        out[i] = np.frombuffer(v)
    return out


def _lines(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    some = np.flatnonzero((total != 0).any(1))
    for a in range(0, len(some), max(1, CELLS // total.shape[1])):
        at = some[a : a + max(1, CELLS // total.shape[1])]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([x.tobytes() for x in total[at]], pa.binary())], names=["i", "values"])


def gram(m: CountMatrix) -> tuple[np.ndarray, pa.Array]:
    """Columns' Gram matrix from outer products of row blocks, summed by matrix row; and the columns' names."""
    names = names_of(m)
    d = len(names)
    if d > GRAM_LIMIT:
        raise ValueError(f"the axis has more than {GRAM_LIMIT} entries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            for a in range(0, batch.num_rows, max(1, CELLS // max(d, 1))):
                part = batch.slice(a, max(1, CELLS // d))
                for ids, owner, j, x in _slices(part):
                    block = np.zeros((len(ids), d))
                    np.add.at(block, (owner, j), x)
                    total += block.T @ block
        yield from _lines(total)

    return _summed(sparse_rows(m, names).mapInArrow(run, "i long, values binary"), d, d), names


@dataclass
class Factors:
    """Singular values (descending) and right factors of the small axis; left ones are X V / s."""

    s: np.ndarray
    v: np.ndarray
    names: pa.Array
    transposed: bool
    shape: tuple[int, int]
    residuals: np.ndarray | None = None  # |X'X v - s^2 v|, where the values are leading ones of a long axis

    @property
    def whole(self) -> bool:
        """Whether these are all singular values."""
        return len(self.s) == min(self.shape)

    def held(self, spark, r: int) -> DataFrame:
        """(id, w): the leading ``r`` factors of the small axis as a table."""
        w = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(self.names) + 1) * r, r), pa.int32()), pa.array(np.ascontiguousarray(self.v[:, :r]).ravel()))
        return spark.createDataFrame(pa.table({"id": self.names, "w": w}))


def svd(m: CountMatrix, k: int | None = None, seed: int = 42) -> Factors:
    """Through the Gram matrix of the smaller axis; where that is longer than GRAM_LIMIT, by a subspace grown until its residuals are small.

    All singular values, or the leading ``k``; a long axis needs a ``k``. Raises if k is no rank of the matrix, if
    factors would take more than FACTOR_BYTES, or if the residuals stay large.
    """
    rows, cols = m.shape
    if k is not None and not 0 < k <= min(rows, cols):
        raise ValueError(f"k must be between 1 and {min(rows, cols)}")
    flip = cols > rows
    x = m.transpose() if flip else m
    if min(rows, cols) > GRAM_LIMIT:
        if k is None:
            raise ValueError(f"the small axis has more than {GRAM_LIMIT} entries: say how many components (k)")
        names, product = products(x)
        return _leading(lanczos.leading(_space(product, names, seed), k=k), names, flip, (rows, cols))
    g, names = gram(x)
    lam, vec = np.linalg.eigh(g)
    order = np.argsort(-np.abs(lam), kind="stable")[: k or len(lam)]
    s, v = np.sqrt(np.abs(lam[order])), vec[:, order]
    return Factors(s, _signed(v), names, flip, (rows, cols))


def _signed(v: np.ndarray) -> np.ndarray:
    """The largest entry of each column is positive, so that factors are the same on every run."""
    if not v.size:
        return v
    top = v[np.abs(v).argmax(0), np.arange(v.shape[1])]
    return v * np.where(top < 0, -1.0, 1.0)


def _projected(cells: DataFrame, line: str, other: str, loadings: DataFrame, r: int, small: bool) -> DataFrame:
    """(line, w): sums over ``other`` of cells times loadings (id, w), which are broadcast if they are ``small``."""
    x = cells.join(F.broadcast(loadings) if small else loadings, F.col(other) == F.col("id"))
    return x.groupBy(line).agg(F.array(*(F.sum(F.col("value") * F.col("w")[j]) for j in range(r))).alias("w"))


def factor(m: CountMatrix, f: Factors, r: int, axis: int) -> DataFrame:
    """(id, w): the leading ``r`` left (axis 0, id is row_id) or right (axis 1) factors of ``m``: held, or X V / s."""
    line, other = ("row_id", "col_id") if axis == 0 else ("col_id", "row_id")
    held = f.held(m.cells.sparkSession, r)
    if f.transposed == (axis == 0):
        return held.withColumnRenamed("id", line)
    w = _projected(m.cells, line, other, held, r, len(f.names) * r * 8 <= 8 << 20)
    return w.select(line, F.transform("w", lambda x, j: F.try_divide(x, F.element_at(F.lit(f.s[:r].tolist()), j + 1))).alias("w"))


def right_factor(m: CountMatrix, f: Factors, j: int) -> DataFrame:
    """(col_id, w): the j-th right factor of ``m``, whichever axis ``f`` holds; its largest entry is positive."""
    w = factor(m, f, j + 1, 1).select("col_id", F.col("w")[j].alias("w"))
    top = w.agg(F.when(F.max("w") < F.max(F.abs("w")), -1.0).otherwise(1.0).alias("sign"))
    return w.crossJoin(F.broadcast(top)).select("col_id", (F.col("w") * F.col("sign")).alias("w"))


def products(x: CountMatrix) -> tuple[pa.Array, lanczos.Product]:
    """The columns' names, and X'X times a block of vectors: a pass over sparse row blocks, whose partial lines are added by Spark."""
    names = names_of(x)
    d = len(names)
    rows = cut(sparse_rows(x, names), "rows")

    def product(q: np.ndarray) -> np.ndarray:
        held, width = rows.sparkSession.sparkContext.broadcast(q), q.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, total = held.value, np.zeros((d, width))
            for batch in batches:
                for ids, owner, j, v in _slices(batch):
                    y = _times(owner, j, v, q, len(ids))
                    for c in range(width):
                        total[:, c] += np.bincount(j, v * y[owner, c], d)
            yield from _lines(total)

        out = _summed(rows.mapInArrow(run, "i long, values binary"), d, width)
        held.destroy()
        return out

    return names, product


def _space(product: lanczos.Product, names: pa.Array, seed: int) -> lanczos.Subspace:
    return lanczos.Subspace(product, len(names), seed=seed, room=FACTOR_BYTES)


def _leading(found: lanczos.Leading, names: pa.Array, flip: bool, shape: tuple[int, int]) -> Factors:
    return Factors(np.sqrt(np.abs(found.values)), _signed(found.vectors), names, flip, shape, found.residuals)


def spectrum_of(m: CountMatrix, k: int | None = None, seed: int = 42) -> tuple[Factors, float, int, float]:
    """(factors, sigma, rank, KS): the noise told by the median of all values, how many exceed the law's edge, and the distance from the law.

    On a small axis within GRAM_LIMIT from all values, or the leading ``k``. Beyond it no step takes all values: those far above the others are
    taken out first, the distribution of the rest (hence median and distance) comes from random chains, and every value above the edge
    that follows is computed with its residual, which goes with the factors. Raises where a value is too close to the edge to be told.
    """
    small, large = sorted(m.shape)
    if small <= GRAM_LIMIT:
        f = svd(m, k, seed)
        sigma = noise_scale(f.s, small, large)
        return f, sigma, mp_rank(f.s, small, large, sigma), ks(f.s, small, large, sigma)
    rows, cols = m.shape
    x, gamma = (m.transpose() if cols > rows else m), small / large
    names, product = products(x)
    space = _space(product, names, seed)
    known, vectors = lanczos.outliers(space)
    law = lanczos.density(product, small, known=known, vectors=vectors, chains=max(8, -(-STARTS // small)), seed=seed)
    sigma = math.sqrt(law.quantile(0.5) / (large * mp_ppf(0.5, gamma)))
    unit = large * sigma * sigma
    found = lanczos.leading(space, above=unit * (1 + math.sqrt(gamma)) ** 2)
    rank = len(found.values)
    if k is not None and k != rank:
        found = lanczos.leading(space, k=k)
    return _leading(found, names, cols > rows, (rows, cols)), sigma, min(rank, len(found.values)), law.distance(lambda p: mp_cdf(p / unit, gamma))


# --- the Marchenko-Pastur law on the driver (of singular values, which it holds)


def mp_cdf(x: np.ndarray, gamma: float) -> np.ndarray:
    g = 1 / gamma if gamma > 1 else gamma
    a, b = (1 - math.sqrt(g)) ** 2, (1 + math.sqrt(g)) ** 2
    y = np.clip(np.asarray(x, float), a, b)
    s = 2 * math.sqrt(g)
    with np.errstate(divide="ignore", invalid="ignore"):
        low = np.where(y > 0, ((1 + g) * y - (1 - g) ** 2) / (s * np.where(y > 0, y, 1)), -1)
    inner = np.sqrt(np.maximum((b - y) * (y - a), 0)) + (1 + g) * np.arcsin(np.clip((y - 1 - g) / s, -1, 1)) - (1 - g) * np.arcsin(np.clip(low, -1, 1))
    return np.where(x <= a, 0.0, np.where(x >= b, 1.0, 0.5 + inner / (2 * math.pi * g)))


def mp_ppf(q: float, gamma: float) -> float:
    g = 1 / gamma if gamma > 1 else gamma
    lo, hi = (1 - math.sqrt(g)) ** 2, (1 + math.sqrt(g)) ** 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if float(mp_cdf(np.array(mid), g)) < q else (lo, mid)
    return (lo + hi) / 2


def noise_scale(s: np.ndarray, m: int, n: int) -> float:
    """Sigma from the median of the singular values of an m x n matrix, m <= n; absent ones are the smallest."""
    y = np.sort(s)
    half = m // 2 + 1
    q, value = (0.5, float(np.median(np.concatenate((np.zeros(m - len(y)), y))))) if len(y) >= half else ((m - len(y)) / m, float(y[0]))
    return value / math.sqrt(n * mp_ppf(q, m / n))


def mp_rank(s: np.ndarray, m: int, n: int, sigma: float) -> int:
    """Values above the edge."""
    return int((s**2 / (n * sigma**2) > (1 + math.sqrt(m / n)) ** 2).sum())


def ks(s: np.ndarray, m: int, n: int, sigma: float) -> float:
    """Kolmogorov-Smirnov distance of the scaled eigenvalues of an m x n matrix and the law; absent values are the smallest."""
    x = np.sort(s**2 / (n * sigma**2))
    f, at = mp_cdf(x, m / n), np.arange(m - len(x), m)
    return float(max(((at + 1) / m - f).max(), (f - at / m).max()))


def normalised_ks(s: np.ndarray, m: int, n: int, sigma: float) -> float:
    """KS of the values below the edge alone, against the law: the noise without the signal."""
    rank = mp_rank(s, m, n, sigma)
    rest = np.sort(s)[::-1][rank:]
    return ks(rest, m - rank, n, sigma) if len(rest) and m > rank else 0.0


def outer(left: DataFrame, line: str, held: np.ndarray, names: pa.Array, other: str) -> DataFrame:
    """Cells (line, other, value) of the product of ``left`` (line, w) with ``held`` (names x components), which is broadcast."""
    if held.nbytes > FACTOR_BYTES:
        raise ValueError(f"a factor takes more than {FACTOR_BYTES} bytes")
    spark, r = left.sparkSession, held.shape[1]
    both = spark.sparkContext.broadcast((held, names))
    kind = pa.schema([("x", names.type)]).field("x").type
    kinds = {pa.string(): "string", pa.large_string(): "string", pa.int64(): "bigint", pa.int32(): "int"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, ids = both.value
        step = min(len(ids), 1 << 14)
        for batch in batches:
            for a in range(0, batch.num_rows, max(1, CELLS // max(1, step))):
                part = batch.slice(a, max(1, CELLS // max(1, step)))
                w = part.column(1).flatten().to_numpy().reshape(-1, r)
                for b in range(0, len(ids), step):
                    z = w @ v[b : b + step].T
                    i, j = np.divmod(np.arange(z.size), z.shape[1])
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(i)), ids.take(pa.array(j + b)), pa.array(z.ravel())], names=[line, other, "value"])

    return left.select(line, "w").mapInArrow(run, f"{line} {dict(left.dtypes)[line]}, {other} {kinds[kind]}, value double").select("row_id", "col_id", "value")


def reconstruct(m: CountMatrix, f: Factors, values: np.ndarray) -> DataFrame:
    """Cells of U diag(values) V^T for the leading ``len(values)`` components: a table of scores times the held factor."""
    r = len(values)
    line, other = ("col_id", "row_id") if f.transposed else ("row_id", "col_id")
    left = factor(m, f, r, 1 if f.transposed else 0)
    return outer(left, line, f.v[:, :r] * np.asarray(values), f.names, other)


def around_rank(values: DataFrame, rank: int, n: int = 10) -> DataFrame:
    """The rows of a spectrum table (component, ...) within ``n`` of the rank's edge, and on which side each is."""
    return values.where(F.col("component").between(rank - n, rank + n - 1)).withColumn("signal", F.col("component") < rank)
