"""Tables that experiments report: spectra of variants, stability, classification, factors' features, losses."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from countloom.bundle import CountMatrix, subsample
from countloom.operators import evaluate, fit as fitting, ranks, spectrum
from countloom.operators.marginals import moments
from countloom.session import cut


def scores(m: CountMatrix, k: int) -> DataFrame:
    """(row_id, values): the leading k left factors times their singular values."""
    f = spectrum.svd(m, k)
    w = spectrum.factor(m, f, k, 0)
    return w.select("row_id", F.transform("w", lambda x, j: x * F.element_at(F.lit(f.s[:k].tolist()), j + 1)).alias("values"))


def element(m: CountMatrix, f: spectrum.Factors, row, col, rank: int | None = None) -> float:
    """One cell of the rank-r approximation; unknown keys raise IndexError, a rank out of range ValueError."""
    r = len(f.s) if rank is None else rank
    if not 0 < r <= len(f.s):
        raise ValueError("rank is out of range")
    line, key = ("col_id", row) if f.transposed else ("row_id", col)
    names = f.names.to_pylist()
    if key not in names:
        raise IndexError(key)
    other = col if f.transposed else row
    x = {c[0]: c[1] for c in m.cells.where(F.col(line) == other).select("row_id" if f.transposed else "col_id", "value").collect()}
    if not x and (m.var if f.transposed else m.obs).where(F.col(line) == other).isEmpty():
        raise IndexError(other)
    dense = np.array([x.get(n, 0.0) for n in names])
    v = f.v[:, :r]
    return float(dense @ v @ v[names.index(key)])


def top_features(f: spectrum.Factors, spark, n: int = 10, by: str = "abs") -> DataFrame:
    """(component, place, feature): the n features of largest loading (absolute, raw or negative) of each component."""
    key = {"abs": np.abs, "raw": lambda x: x, "neg": lambda x: -x}[by]
    names = f.names.to_pylist()
    rows = [(j, p, str(names[i])) for j in range(f.v.shape[1]) for p, i in enumerate(np.argsort(-key(f.v[:, j]), kind="stable")[:n].tolist())]
    return spark.createDataFrame(rows, "component int, place int, feature string")


def rank_to_sigma(s: np.ndarray, rank: int, m: int, n: int) -> float:
    """The noise scale under which exactly ``rank`` values stand above the edge: halfway to the next value."""
    y = np.sort(s)[::-1]
    edge = 1 + math.sqrt(m / n)
    upper = y[rank - 1] if rank else np.inf
    lower = y[rank] if rank < len(y) else 0.0
    return float((lower if not np.isfinite(upper) else (upper + lower) / 2) / (math.sqrt(n) * edge))


def density_loss(eigs: np.ndarray, gamma: float, *, power: int = 2, points: int = 2000) -> float:
    """Trapezoid integral of |empirical - law|^power between the cumulative distributions of eigenvalues."""
    a, b = (1 - math.sqrt(gamma)) ** 2, (1 + math.sqrt(gamma)) ** 2
    x = np.linspace(a, max(b, float(eigs.max())), points)
    e = np.searchsorted(np.sort(eigs), x, "right") / len(eigs)
    d = np.abs(e - spectrum.mp_cdf(x, gamma)) ** power
    return float(((d[1:] + d[:-1]) / 2 * np.diff(x)).sum())


def classifier(points: DataFrame, ks: list[int], *, folds: int = 5, seed: int = 34) -> DataFrame:
    """(k, fold, accuracy): held-out folds by seeded hash; each test point votes among the training points.

    ``points`` are (id, values, label). Every point is tested once, against all points of the other folds.
    """
    p = points.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(folds)).cast("int"))
    near = evaluate.nearest_in_folds(p, max(ks))
    votes = near.select("fa", F.col("la").cast("double").alias("la"), F.col("lb").cast("array<double>").alias("lb")).mapInArrow(_votes(sorted(set(ks))), "k int, fold int, good long, n long")
    return votes.groupBy("k", "fold").agg(F.sum("good").alias("good"), F.sum("n").alias("n")).select("k", "fold", F.try_divide("good", "n").alias("accuracy"))


def _votes(ks: list[int]):
    """For each k and fold how many points have neighbours, and of how many the most frequent label (ties to the smallest) is their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, seen = Counter(), Counter()
        for batch in batches:
            lists = batch.column("lb")
            size = lists.value_lengths().to_numpy(zero_copy_only=False)
            names, code = np.unique(lists.flatten().to_numpy(zero_copy_only=False).astype(float), return_inverse=True)  # no label (NaN) comes last
            ends, own, folds = np.concatenate([[0], np.cumsum(size)]), batch.column("la").to_numpy(zero_copy_only=False).astype(float), batch.column("fa").to_numpy()
            step = max(1, (1 << 21) // max(1, len(names)))
            for a in range(0, len(size) if len(names) else 0, step):
                n = len(size[a : a + step])
                row = np.repeat(np.arange(n), size[a : a + n])
                at, place = code[ends[a] : ends[a + n]], np.arange(ends[a], ends[a + n]) - ends[a + row]
                for k in ks:
                    counts = np.bincount((row * len(names) + at)[place < k], minlength=n * len(names)).reshape(n, -1)
                    said = names[counts.argmax(1)]
                    told = (size[a : a + n] > 0) & ~np.isnan(said) & ~np.isnan(own[a : a + n])
                    for fold in np.unique(folds[a : a + n]).tolist():
                        here = folds[a : a + n] == fold
                        seen[k, fold] += int((told & here).sum())
                        good[k, fold] += int((told & here & (said == own[a : a + n])).sum())
        rows = [(k, fold, good[k, fold], n) for (k, fold), n in seen.items()]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["k", "fold", "good", "n"])

    return run


def grassmann(a: np.ndarray, b: np.ndarray) -> float:
    """Distance of two column spaces: the root of the summed squared principal angles."""
    qa, qb = np.linalg.qr(a)[0], np.linalg.qr(b)[0]
    s = np.clip(np.linalg.svd(qa.T @ qb, compute_uv=False), -1, 1)
    return float(np.sqrt((np.arccos(s) ** 2).sum()))


def affine_coordinates(x: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
    """(orthonormal directions, displacement) of the affine space of leading components of the rows."""
    mean = x.mean(0)
    d = np.linalg.svd(x - mean, full_matrices=False)[2][:r].T
    return d, mean - d @ (d.T @ mean)


def stiefel(directions: np.ndarray, displacement: np.ndarray) -> np.ndarray:
    """An affine space as a linear one of one dimension more."""
    g = 1 / math.sqrt(1 + float(displacement @ displacement))
    n, r = directions.shape
    out = np.zeros((n + 1, r + 1))
    out[:n, :r] = directions
    out[:n, r], out[n, r] = g * displacement, g
    return out


def stability(m: CountMatrix, *, share: float = 0.75, repeats: int = 3, seed: int = 0, parameters: dict | None = None) -> DataFrame:
    """(repeat, rank, sigma, ks): fits of seeded subsets of the rows, each with its own variance fit unless ``parameters`` are given."""
    spark, rows = m.cells.sparkSession, []
    n = max(2, int(m.obs.count() * share))
    for i in range(repeats):
        sub = m.submatrix(rows=subsample(m.obs.select("row_id"), "row_id", n, seed + i))
        sub = CountMatrix(sub.cells, sub.obs, sub.cells.select("col_id").distinct())
        f = fitting.fit(sub, parameters)
        rows.append((i, f.rank, float(f.sigma), float(f.kst)))
    return spark.createDataFrame(rows, "repeat int, rank int, sigma double, ks double")


def parameter_table(samples: dict[str, CountMatrix], metric=None, **options) -> DataFrame:
    """(sample, rows, columns, rank, sigma, ks, bhat, chat, b, c): one fit for each sample, whose names and results are few.

    A ``metric``, a function of (matrix, fit) to a number, adds a column of that name. What a fit does not estimate is null.
    """
    rows, names = [], ("bhat", "chat", "b", "c")
    for name, m in sorted(samples.items()):
        f = fitting.fit(m, **options)
        found = [None if f.parameters.get(k) is None else float(f.parameters[k]) for k in names]
        rows.append((name, *m.shape, f.rank, float(f.sigma), float(f.kst), *found, *([] if metric is None else [float(metric(m, f))])))
    schema = "sample string, rows long, columns long, rank int, sigma double, ks double, " + ", ".join(f"{k} double" for k in names)
    return next(iter(samples.values())).cells.sparkSession.createDataFrame(rows, schema + ("" if metric is None else f", {metric.__name__} double"))


def depth_correlation(m: CountMatrix, k: int = 5) -> DataFrame:
    """(component, r): Pearson correlation of each component's scores with the rows' totals."""
    depth = m.cells.groupBy("row_id").agg(F.sum("value").alias("depth"))
    s = scores(m, k).join(depth, "row_id")
    return s.select("depth", F.posexplode("values").alias("component", "score")).groupBy("component").agg(F.corr("depth", "score").alias("r"))


def low_rank_moments(m: CountMatrix, k: int) -> DataFrame:
    """Mean and variance by column of the rank-k approximation."""
    f = spectrum.svd(m, k)
    return moments(m.with_cells(spectrum.reconstruct(m, f, f.s[:k])), 0)


def regress_out(m: CountMatrix, covariates: DataFrame) -> DataFrame:
    """Residuals of the dense matrix on covariates (row_id, c1, c2, ...) and a constant by least squares, per column; rows without covariates are left out.

    The normal equations' matrix is shared: sums over rows once, of a few covariates, inverted (pseudo-inverse, so covariates that depend on
    others do no harm) on the driver. Their right sides come from the stored cells alone, as centred covariates add up to nothing.
    """
    names = [c for c in covariates.columns if c != "row_id"]
    c = cut(covariates.select("row_id", F.array(*(F.col(n).cast("double") for n in names)).alias("c")).join(m.obs.select("row_id"), "row_id"), "covariates")
    p = range(len(names))
    at = lambda x, i: F.col(x)[i]
    first = c.agg(F.count("*").alias("n"), *(F.avg(at("c", i)) for i in p)).first()
    if not first[0]:
        return m.cells.limit(0).select("row_id", "col_id", "value")
    mean = list(first[1:])
    gram = np.array(c.agg(*(F.sum((at("c", i) - mean[i]) * (at("c", j) - mean[j])) for i in p for j in p)).first(), float).reshape(len(names), len(names))
    unit = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    inverse = np.linalg.pinv(gram / np.outer(unit, unit), rcond=1e-9, hermitian=True) / np.outer(unit, unit)
    inner = m.submatrix(rows=c)
    sides = inner.cells.join(c, "row_id").groupBy("col_id").agg((F.sum("value") / first[0]).alias("mv"), *(F.sum(F.col("value") * (at("c", i) - mean[i])).alias(f"b{i}") for i in p))
    slope = F.array(*(sum((F.col(f"b{j}") * float(inverse[i, j]) for j in p), F.lit(0.0)) for i in p)).alias("slope")
    d = inner.densify().join(c, "row_id").join(sides.select("col_id", "mv", slope), "col_id", "left")  # columns without a cell are 0 and stay so
    fitted = sum((at("slope", i) * (at("c", i) - mean[i]) for i in p), F.col("mv"))
    return d.select("row_id", "col_id", F.coalesce(F.col("value") - fitted, F.lit(0.0)).alias("value"))


def scaled(cells: DataFrame, most: float = 10.0) -> DataFrame:
    """z-scores cut at ``most``."""
    return cells.withColumn("value", F.least("value", F.lit(most)))


def truncate_quantile(cells: DataFrame, q: float, axis: str = "col_id") -> DataFrame:
    """Values below the absolute q-quantile of their column (or row) become zero and are dropped."""
    t = ranks.quantiles(cells, [axis], "value", [q], ["t"]).withColumn("t", F.abs("t"))
    return cells.join(t, axis).where(F.col("value") > F.col("t")).drop("t")


def noise_run(m: CountMatrix, seed: int = 42) -> CountMatrix:
    """The matrix with seeded random signs: of the same sizes cell by cell, but without what rows or columns have in common."""
    sign = F.when(F.pmod(F.xxhash64(F.lit(seed), "row_id", "col_id"), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    return m.map_values(F.col("value") * sign)


def choose_rank(s: np.ndarray, top: float, energy: float, margin: float = 1.05) -> int:
    """How many leading singular values exceed ``top``, the largest one of a noise run, by the ``margin``.

    The noise run has the energy (sum of squares) of the whole matrix, components included: so what is found is taken out of it, and
    ``top`` falls as the root of what is left, until nothing more is found.
    """
    found, k = -1, 0
    while energy and k > found:
        found = k
        edge = margin * top * math.sqrt(max(energy - (s[:found] ** 2).sum(), 0.0) / energy)
        k = max(found, int((s > edge).cumprod().sum()))
    return k


def gap_rank(s: np.ndarray, *, noise_share: float = 0.2, deviations: float = 6.0) -> int:
    """The last gap between neighbouring singular values that exceeds the mean gap of the tail (``noise_share``) by ``deviations`` standard deviations.

    Gaps at the edge of pure noise are larger than those within, so weak noise values may count; ``choose_rank`` has no such fault.
    """
    gaps = -np.diff(s)
    tail = gaps[int(len(s) * (1 - noise_share)) :]
    if len(tail) < 2:
        raise ValueError("too few singular values to tell noise")
    out = np.flatnonzero(gaps > tail.mean() + deviations * tail.std(ddof=1))
    return int(out[-1]) + 1 if len(out) else 0


#: Leading singular values among which a rank is chosen.
CHOICE = 100


def low_rank_threshold(m: CountMatrix, k: int | None = None, q: float = 0.001) -> DataFrame:
    """Rank-k values above the absolute q-quantile of their column, zeros elsewhere; known non-zeros are kept.

    Without ``k`` it is chosen among the leading CHOICE singular values by a noise run (at least 1; raises if all of them exceed it and there are more).
    """
    f = spectrum.svd(m, k or min(CHOICE, *m.shape))
    if k is None:
        k = choose_rank(f.s, float(spectrum.svd(noise_run(m), 1).s[0]), m.cells.agg(F.sum(F.col("value") * F.col("value"))).first()[0])
        if k == len(f.s) < min(m.shape):
            raise ValueError(f"more than {k} components: say how many (k)")
        k = max(1, k)
    low = spectrum.reconstruct(m, f, f.s[:k])
    kept = truncate_quantile(low, q).withColumnRenamed("value", "z")
    known = m.cells.withColumnRenamed("value", "x")
    return kept.join(known, ["row_id", "col_id"], "full").select("row_id", "col_id", F.coalesce("z", "x").alias("value"))


def block_pairs(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """Cells of a symmetric contact matrix by pair of regions (bin_id, region), off the diagonal: (left, right, ...)."""
    a = regions.select(F.col("bin_id").alias("row_id"), F.col("region").alias("left"))
    b = regions.select(F.col("bin_id").alias("col_id"), F.col("region").alias("right"))
    return cells.join(a, "row_id").join(b, "col_id").where("left < right")


def relabelled(labels: DataFrame, names: dict, where: Column | None = None) -> DataFrame:
    """Cluster labels by name; only rows where ``where`` holds are overwritten."""
    pairs = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    new = F.coalesce(F.try_element_at(pairs, F.col("label")), F.col("label").cast("string"))
    return labels.withColumn("label", new if where is None else F.when(where, new).otherwise(F.col("label").cast("string")))


def silhouette_by_components(m: CountMatrix, labels: DataFrame, ks: list[int]) -> DataFrame:
    """(k, silhouette): mean silhouette of all rows over the leading k components."""
    out = None
    all_scores = scores(m, max(ks)).join(labels, "row_id").select(F.col("row_id").alias("id"), "values", "label")
    for k in ks:
        p = all_scores.withColumn("values", F.slice("values", 1, k))
        s = evaluate.silhouette_of_all(p).agg(F.avg("silhouette").alias("silhouette")).select(F.lit(k).alias("k"), "silhouette")
        out = s if out is None else out.unionByName(s)
    return out
