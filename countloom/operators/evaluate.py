"""Distances, neighbours, rank statistics and graph scores.

Distances pair a stated set of queries with all points; a table of all pairs is quadratic by nature and meant for
reduced (sampled or clustered) point sets. Scores of all points against all points come from pairs of blocks: the work is
quadratic, but only the nearest points or the sums by class leave a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from countloom.functions.elementwise import t_quantile, two_sided
from countloom.operators import neighbours, ranks, sampling
from countloom.operators.neighbours import _CELLS, _approximate, _exact, _rounded, _values
from countloom.session import cut

#: Points of a query block whose sums by class leave it.
QUERIES = 8192


def squared_distances(points: DataFrame, queries: DataFrame, col: str = "values") -> DataFrame:
    """(a, b, d2) of every query a with every other point b; both tables are (id, values, ...)."""
    q = queries.select(F.col("id").alias("a"), F.col(col).alias("x"))
    p = points.select(F.col("id").alias("b"), F.col(col).alias("y"))
    d2 = F.aggregate(F.zip_with("x", "y", lambda s, t: (s - t) * (s - t)), F.lit(0.0), lambda acc, v: acc + v)
    return q.join(p, F.col("a") != F.col("b")).select("a", "b", d2.alias("d2"))


def distances(points: DataFrame, queries: DataFrame, digits: int, squared: int) -> DataFrame:
    """(a, b, distance) of every query a with every other point b, rounded to ``digits`` after its square to ``squared`` ones; both are (id, values).

    Pairs of blocks meet and their rows leave a task as a stream. Products tell a distance but near the middle between two rounded
    values; there the squares are summed one by one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        left, right = t.filter(pc.field("query")), t.filter(~pc.field("query"))
        x, y, ids, others = _values(left, "values"), _values(right, "values"), left.column("id").to_numpy(), right.column("id").to_numpy()
        for at in range(0, len(x), 64):
            for c in range(0, len(y), 4096):
                p, q, a, b = x[at : at + 64], y[c : c + 4096], ids[at : at + 64], others[c : c + 4096]
                d, size = _approximate(p, q)
                with np.errstate(all="ignore"):
                    v = np.sqrt(d) * 10.0**digits
                    margin = 100.0**digits * ((p.shape[1] + 8) * 2.0**-50 * size + 10.0**-squared) / v
                    unsure = np.argwhere(~((np.abs(v - np.floor(v) - 0.5) > margin) & (margin < 0.5)))
                    v = np.floor(v + 0.5) / 10.0**digits
                    v[unsure[:, 0], unsure[:, 1]] = _rounded(np.sqrt(_rounded(_exact(p[unsure[:, 0]], q[unsure[:, 1]]), squared)), digits)
                other = a[:, None] != b
                rows = [np.repeat(a, len(b)), np.tile(b, len(a)), v.ravel()]
                if not other.all():
                    rows = [r[other.ravel()] for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(r) for r in rows], names=["a", "b", "distance"])

    cast = lambda x: x.select(F.col("id").cast("long").alias("id"), "values")
    p, q = (cast(x.where("values IS NOT NULL")) for x in (points, queries))
    first = p.first()
    shape = (1, 1) if first is None else neighbours.grid(q.count(), p.count(), len(first["values"]))
    left, right = neighbours.in_blocks(q, p, *shape)
    out = left.withColumn("query", F.lit(True)).unionByName(right.withColumn("query", F.lit(False))).groupBy("i", "j").applyInArrow(run, "a long, b long, distance double")
    lost = cast(points).where("values IS NULL")
    if lost.isEmpty():
        return out
    side = lambda x, name: cast(x).select(F.col("id").alias(name), F.col("values").isNull().alias(f"no_{name}"))
    without = side(queries, "a").join(side(points, "b"), (F.col("a") != F.col("b")) & (F.col("no_a") | F.col("no_b")))  # no distance
    return out.unionByName(without.select("a", "b", F.lit(None).cast("double").alias("distance")))


def nearest(distances: DataFrame, k: int) -> DataFrame:
    """The k nearest of each a, ties by id."""
    w = Window.partitionBy("a").orderBy("d2", "b")
    return distances.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def agreement(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """Share of neighbours with the point's own label."""
    la, lb = labels.select(F.col("id").alias("a"), F.col("label").alias("la")), labels.select(F.col("id").alias("b"), F.col("label").alias("lb"))
    return neighbours.join(la, "a").join(lb, "b").agg(F.avg((F.col("la") == F.col("lb")).cast("double")).alias("agreement"))


def majority(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """Most frequent label among the neighbours, ties to the smallest."""
    lb = labels.select(F.col("id").alias("b"), "label")
    votes = neighbours.join(lb, "b").groupBy("a", "label").agg(F.count("*").alias("votes"))
    best = votes.groupBy("a").agg(F.max_by("label", F.struct("votes", -F.col("label"))).alias("predicted"))
    return best


def balanced_accuracy(predicted: DataFrame, labels: DataFrame) -> DataFrame:
    both = predicted.join(labels.select(F.col("id").alias("a"), "label"), "a")
    recall = both.groupBy("label").agg(F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("recall"))
    return recall.agg(F.avg("recall").alias("balanced_accuracy"))


def mixing(neighbours: DataFrame, batches: DataFrame, critical: float) -> DataFrame:
    """Chi-square of each point's neighbour batches against the overall shares, and whether it is below ``critical``."""
    shares = batches.groupBy("label").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy())).select("label", "share")
    lb = batches.select(F.col("id").alias("b"), "label")
    seen = neighbours.join(lb, "b").groupBy("a", "label").agg(F.count("*").alias("seen"))
    k = neighbours.groupBy("a").agg(F.count("*").alias("k"))
    grid = k.join(F.broadcast(shares)).join(seen, ["a", "label"], "left")
    e = F.col("k") * F.col("share")
    chi = grid.groupBy("a").agg(F.sum(F.pow(F.coalesce("seen", F.lit(0)) - e, 2) / e).alias("chi2"))
    return chi.withColumn("mixed", F.col("chi2") < critical)


def silhouette(distances: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, silhouette) over Euclidean distances; points alone in their class get 0."""
    la, lb = labels.select(F.col("id").alias("a"), F.col("label").alias("la")), labels.select(F.col("id").alias("b"), F.col("label").alias("lb"))
    mean = distances.join(la, "a").join(lb, "b").groupBy("a", "la", "lb").agg(F.avg(F.sqrt("d2")).alias("d"))
    return _silhouette(mean)


def _silhouette(mean: DataFrame) -> DataFrame:
    s = mean.groupBy("a").agg(F.min(F.when(F.col("la") == F.col("lb"), F.col("d"))).alias("own"), F.min(F.when(F.col("la") != F.col("lb"), F.col("d"))).alias("other"))
    return s.select("a", F.when(F.col("own").isNull() | (F.greatest("own", "other") == 0), 0.0).otherwise((F.col("other") - F.col("own")) / F.greatest("own", "other")).alias("silhouette"))


def block_pairs(points: DataFrame, columns: list[str], run, schema: str, queries: DataFrame | None = None) -> DataFrame:
    """``run`` on each pair of a block of queries (or of all points) and a block of all points: (id, values, *columns) on both sides."""
    p = points.select("id", "values", *columns)
    q = p if queries is None else queries.select("id", "values", *columns)
    first = p.first()
    shape = (1, 1) if first is None else neighbours.grid(q.count(), p.count(), len(first["values"]), most=QUERIES)
    left, right = neighbours.in_blocks(q, p, *shape)
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(run, schema)


def nearest_in_folds(points: DataFrame, k: int) -> DataFrame:
    """(a, la, fa, lb): labels of the k nearest points of other folds in order, ties by id; ``points`` are (id, values, label, fold)."""
    return _nearest_lists(points, k).select("a", "la", F.col("fa").cast("int").alias("fa"), F.col("near")["lb"].alias("lb"))


def nearest_of_all(points: DataFrame, k: int, queries: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """(a, b, rank, d2): the k nearest other points of every point (or of ``queries``, some of them), ties by id; ``points`` are (id, values).

    With ``digits`` squared distances are rounded before they are compared. The lists are stored, so what reads them twice does not search twice.
    """
    near = _stored_lists(points, k, queries, digits).select("a", F.posexplode("near").alias("at", "n"))
    return near.select("a", F.col("n.b").alias("b"), (F.col("at") + 1).alias("rank"), F.col("n.d2").alias("d2"))


def _stored_lists(points: DataFrame, k: int, queries: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    own = lambda x: x.select("id", "values", F.lit(0).alias("label"), F.col("id").alias("fold"))  # noqa: E731  a point is its own fold
    return cut(_nearest_lists(own(points), k, None if queries is None else own(queries), digits), "nearest")


def _nearest_lists(points: DataFrame, k: int, queries: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """(a, la, fa, near): per point, or per one of ``queries``, the k nearest (d2, b, lb) of other folds; points without values are none.

    Queries, and points up to a few blocks, are held against every block; beyond, only cells of points that may hold one of the k (``neighbours``).
    """
    cast = lambda x: x.where("values IS NOT NULL").select(F.col("id").cast("long").alias("id"), "values", F.col("label").cast("int").alias("label"), F.col("fold").cast("long").alias("fold"))
    p = cast(points)
    if queries is not None:
        return neighbours.block_lists(cast(queries), p, k, digits)
    blocks = lambda: neighbours.block_lists(p, p, k, digits)
    if p.limit(neighbours.SMALL + 1).count() > neighbours.SMALL:
        return neighbours.nearest_lists(p, k, otherwise=blocks, digits=digits)
    return blocks()


def silhouette_of_all(points: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """(a, silhouette) of every point (or of ``queries``, some of them) against all others, from sums of distances by class; ``points`` are (id, values, label).

    Points without label are in no class and score 0; those without values are left out.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        x, y = _values(left, "values"), _values(right, "values")
        labels = pa.chunked_array(right.column("label").chunks, pa.int32()).combine_chunks().dictionary_encode(null_encoding="encode")
        names, code = labels.dictionary, labels.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        y, starts = y[order], np.searchsorted(code[order], np.arange(len(names)))
        sums = np.zeros((len(x), len(names)))
        step = max(1, _CELLS // max(1, len(y)))
        for at in range(0, len(x) if len(y) else 0, step):
            d, size = _approximate(x[at : at + step], y)
            near = np.argwhere(d < 1e-6 * size)  # products lose the digits of small distances
            for some in np.array_split(near, len(near) // (1 << 16) + 1):
                d[some[:, 0], some[:, 1]] = _exact(x[at + some[:, 0]], y[some[:, 1]])
            sums[at : at + step] = np.add.reduceat(np.sqrt(d, out=d), starts, axis=1)
        counts = np.broadcast_to(np.bincount(code, minlength=len(names)).astype(float), sums.shape)
        a, c = np.repeat(np.arange(len(x)), len(names)), np.tile(np.arange(len(names)), len(x))
        return pa.table({"a": left.column("id").take(a), "la": left.column("label").take(a), "lb": names.take(pa.array(c)), "d": sums.ravel(), "n": counts.ravel()})

    whole = lambda x: x.where("values IS NOT NULL").select(F.col("id").cast("long").alias("id"), "values", F.col("label").cast("int").alias("label"))
    parts = block_pairs(whole(points), ["label"], run, "a long, la int, lb int, d double, n double", None if queries is None else whole(queries))
    mean = parts.groupBy("a", "la", "lb").agg(F.sum("d").alias("d"), (F.sum("n") - F.col("la").eqNullSafe(F.col("lb")).cast("int")).alias("n"))  # without the point itself
    mean = mean.where("n > 0").select("a", "la", "lb", (F.col("d") / F.col("n")).alias("d"))
    return _silhouette(mean)


def _rank_sums(df: DataFrame, by: list[str], value: str, positive: str) -> DataFrame:
    """(by, n_pos, n_neg, u, ties) from the ranks of distinct values and how many of either class have them: rows are not sorted."""
    of = lambda c: F.when(c, 1).otherwise(0).cast("long")
    x = ranks.ranks(df, by, value, {"pos": of(F.col(positive)), "neg": of(~F.col(positive))})
    s = x.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(F.when(F.col("pos") > 0, F.col("pos") * F.col("rank"))).alias("r"), F.sum(F.pow("n", 3) - F.col("n")).alias("ties"))
    return s.select(*by, "n_pos", "n_neg", (F.col("r") - F.col("n_pos") * (F.col("n_pos") + 1) / 2.0).alias("u"), "ties")


def auc(df: DataFrame, by: list[str], value: str, positive: str) -> DataFrame:
    """Area under the ROC curve from rank sums, and the Mann-Whitney U."""
    return _rank_sums(df, by, value, positive).select(*by, "n_pos", "n_neg", "u", F.try_divide("u", (F.col("n_pos") * F.col("n_neg")).cast("double")).alias("auc"))


def balanced_auc(df: DataFrame, by: list[str], value: str, positive: str, id_col: str, *, seed: int = 42) -> DataFrame:
    """``auc`` on as many rows of either class in each group: of the larger class a keyed sample of exactly the smaller one's size.

    The sample is those rows whose seeded hash of ``id_col`` is smallest, so every run takes the same; ids tell rows of a group apart.
    """
    held = df.where(F.col(value).isNotNull() & F.col(positive).isNotNull())
    sizes = held.groupBy(*by).agg(F.least(F.count_if(F.col(positive)), F.count_if(~F.col(positive))).alias("keep_"))
    return auc(sampling.quota(held, [*by, positive], sizes, by, "keep_", id_col, seed=seed), by, value, positive)


def mann_whitney_z(df: DataFrame, by: list[str], value: str, positive: str) -> DataFrame:
    """U with its tie-corrected normal score."""
    x = _rank_sums(df, by, value, positive)
    n = F.col("n_pos") + F.col("n_neg")
    sd = F.sqrt(F.col("n_pos") * F.col("n_neg") / 12.0 * (n + 1 - F.col("ties") / (n * (n - 1))))
    return x.select(*by, "u", F.try_divide(F.col("u") - F.col("n_pos") * F.col("n_neg") / 2.0, sd).alias("z"))


def mann_whitney_p(df: DataFrame, by: list[str], value: str, positive: str) -> DataFrame:
    """(by, p, p_adjusted): two-sided p of the normal score (ties and continuity corrected), and times the number of groups, at most 1."""
    x = _rank_sums(df, by, value, positive)
    n, both = F.col("n_pos") + F.col("n_neg"), F.col("n_pos") * F.col("n_neg")
    sd = F.sqrt(both / 12.0 * (n + 1 - F.col("ties") / (n * (n - 1))))
    z = F.try_divide(F.greatest(F.abs(F.col("u") - both / 2.0) - 0.5, F.lit(0.0)), sd)
    p = x.select(*by, two_sided(z).alias("p"))
    groups = p.agg(F.count("*").alias("groups"))
    return p.crossJoin(F.broadcast(groups)).select(*by, "p", F.least(F.lit(1.0), F.col("p") * F.col("groups")).alias("p_adjusted"))  # one row


def significant(p: DataFrame, level: float = 0.01, col: str = "p_adjusted") -> DataFrame:
    """(n_tests, n_significant): how many p values fall below ``level``."""
    return p.agg(F.count("*").alias("n_tests"), F.count_if(F.col(col) < level).alias("n_significant"))


def gaussian_affinity(distances: DataFrame, sigma: float) -> DataFrame:
    return distances.select("a", "b", F.exp(-F.col("d2") / (2 * sigma * sigma)).alias("w"))


def adaptive_affinity(distances: DataFrame, k: int) -> DataFrame:
    """exp(-d^2 / (s_a s_b)), s the distance to the k-th neighbour."""
    kth = nearest(distances, k).where(F.col("rank") == k).select("a", F.sqrt("d2").alias("s"))
    return distances.join(kth, "a").join(kth.select(F.col("a").alias("b"), F.col("s").alias("t")), "b").select("a", "b", F.exp(-F.col("d2") / (F.col("s") * F.col("t"))).alias("w"))


def mutual_affinity(distances: DataFrame, k: int) -> DataFrame:
    """The mean of exp(-d^2 / s_a^2) and exp(-d^2 / s_b^2), s the distance to the k-th neighbour; a point's own affinity is 1."""
    kth = nearest(distances, k).where(F.col("rank") == k).select("a", F.col("d2").alias("s2"))
    both = distances.join(kth, "a").join(kth.select(F.col("a").alias("b"), F.col("s2").alias("t2")), "b")
    w = both.select("a", "b", ((F.exp(-F.col("d2") / F.col("s2")) + F.exp(-F.col("d2") / F.col("t2"))) / 2).alias("w"))
    return w.unionByName(kth.select("a", F.col("a").alias("b"), F.lit(1.0).alias("w")))


def sparse_affinity(points: DataFrame, k: int) -> DataFrame:
    """Of every point's k nearest: exp(-d^2 / s^2), s the distance to neighbour k + 1, averaged with its transpose.

    The neighbours come from blocks; n k edges leave them at most twice. Where neighbour k + 1 is a copy of the point (s = 0) its
    k nearest are copies too and have affinity 1.
    """
    near = _stored_lists(points, k + 1).where(F.size("near") > k)
    half = near.select("a", F.element_at(F.col("near")["d2"], k + 1).alias("s2"), F.explode(F.slice("near", 1, k)).alias("n"))
    half = half.select("a", F.col("n.b").alias("b"), (F.exp(-F.coalesce(F.try_divide("n.d2", "s2"), F.lit(0.0))) / 2).alias("w"))
    return half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.sum("w").alias("w"))


def normalized_graph(affinity: DataFrame, kind: str = "normalized") -> DataFrame:
    """(a, b, p): w / sqrt(d_a d_b), w / d_a for a random walk, or w itself where ``unnormalized``."""
    if kind not in ("normalized", "random_walk", "unnormalized"):
        raise ValueError("kind is normalized, random_walk or unnormalized")
    if kind == "unnormalized":
        return affinity.select("a", "b", F.col("w").alias("p"))
    d = affinity.groupBy("a").agg(F.sum("w").alias("d"))
    x = affinity.join(d, "a")
    if kind == "random_walk":
        return x.select("a", "b", (F.col("w") / F.col("d")).alias("p"))
    return x.join(d.select(F.col("a").alias("b"), F.col("d").alias("e")), "b").select("a", "b", (F.col("w") / F.sqrt(F.col("d") * F.col("e"))).alias("p"))


def laplacian_scores(values: DataFrame, graph: DataFrame) -> DataFrame:
    """x' (I - P) x of each feature; values are (id, feature, value)."""
    xa, xb = values.select(F.col("id").alias("a"), "feature", F.col("value").alias("x")), values.select(F.col("id").alias("b"), "feature", F.col("value").alias("y"))
    cross = graph.join(xa, "a").join(xb, ["b", "feature"]).groupBy("feature").agg(F.sum(F.col("p") * F.col("x") * F.col("y")).alias("c"))
    own = values.groupBy("feature").agg(F.sum(F.col("value") * F.col("value")).alias("o"))
    return own.join(cross, "feature", "left").select("feature", (F.col("o") - F.coalesce("c", F.lit(0.0))).alias("score"))


def laplacian_scores_of_vectors(points: DataFrame, graph: DataFrame) -> DataFrame:
    """``laplacian_scores`` of every place of the vectors: (feature, score) of ``points`` (id, values), features from 0.

    An edge meets its two vectors whole, once for both directions; only sums leave a task.
    """

    def sums(of: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                t = pa.Table.from_batches([batch])
                if len(t):
                    x = _values(t, of[0]) * _values(t, of[-1])
                    part = t.column("p").to_numpy() @ x
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["feature", "s"])

        return run

    x = points.select("id", F.col("values").alias("x")).where("x IS NOT NULL")
    edges = graph.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("p").alias("p"))
    both = edges.join(x.select(F.col("id").alias("b"), F.col("x").alias("y")), "b").join(x.select(F.col("id").alias("a"), "x"), "a").select("p", "x", "y")
    cross = both.mapInArrow(sums(["x", "y"]), "feature int, s double").groupBy("feature").agg(F.sum("s").alias("c"))
    own = x.select(F.lit(1.0).alias("p"), "x").mapInArrow(sums(["x"]), "feature int, s double").groupBy("feature").agg(F.sum("s").alias("o"))
    return own.join(cross, "feature", "left").select("feature", (F.col("o") - F.coalesce("c", F.lit(0.0))).alias("score"))


def kde(points: DataFrame, grid: DataFrame, bandwidth: float) -> DataFrame:
    """Gaussian density of ``points`` (x) on ``grid`` (g)."""
    from math import pi, sqrt

    k = F.exp(-F.pow((F.col("g") - F.col("x")) / bandwidth, 2) / 2) / (bandwidth * sqrt(2 * pi))
    return points.join(F.broadcast(grid)).groupBy("g").agg(F.avg(k).alias("density"))


def kde_scott(points: DataFrame, grid: DataFrame) -> DataFrame:
    """``kde`` by Scott's rule: the bandwidth is the sample's standard deviation times n to the power of -1/5.

    Null points are left out; without at least two different values there is no bandwidth, and densities are null.
    """
    p = points.where(F.col("x").isNotNull()).select("x")
    h = p.agg((F.stddev_samp("x") * F.pow(F.count("x"), F.lit(-0.2))).alias("h"))
    z = F.try_divide(F.col("g") - F.col("x"), F.col("h"))
    k = F.try_divide(F.exp(-z * z / 2), F.col("h") * F.sqrt(2 * F.pi()))
    return p.join(F.broadcast(h)).join(F.broadcast(grid)).groupBy("g").agg(F.avg(k).alias("density"))  # one row, and the grid


def mean_t_interval(df: DataFrame, by: list[str], value: str, level: float = 0.95) -> DataFrame:
    """(by, n, mean, half_width): the interval of the mean by Student's t; one value has no width (null)."""
    x = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("_s"))
    half = t_quantile((1 + level) / 2, F.col("n") - 1) * F.col("_s") / F.sqrt("n")
    return x.select(*by, "n", "mean", F.when(F.col("n") > 1, half).alias("half_width"))
