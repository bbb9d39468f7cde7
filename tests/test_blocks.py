"""Work on pairs of blocks: results against plain joins and brute force, and what the plans may not hold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from countloom.bundle import CountMatrix
from countloom.operators import algebra, evaluate, experiments, linkage, neighbours
from countloom.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 5))
    x[40:60] = x[40]
    x[70] = x[75] + 1e-6
    return spark.createDataFrame([(i, [float(v) for v in x[i]], i % 4 if i != 80 else 9) for i in range(300)], "id long, values array<double>, label int")


def queries(points):
    return points.where("id % 5 = 0")


@pytest.mark.parametrize("case", ["noise", "offset", "tiny", "huge", "copies", "folds", "one fold", "not finite", "few"])
@pytest.mark.parametrize("digits", [None, 9])
def test_kernel(case, digits):
    """The k nearest beyond the first columns, in single precision and not, as brute force has them."""
    rng = np.random.default_rng(0)
    n, m, dim, k = 20, 9000, 6, 7
    y, ids = rng.normal(size=(m, dim)), rng.permutation(m) * 3
    y = {"offset": y + 1e5, "tiny": y * 1e-30, "huge": y * 1e25}.get(case, y)
    if case == "copies":
        y[::3] = y[0]
    fy = {"folds": ids % 5, "one fold": (np.arange(m) > m - 30).astype(int)}.get(case, ids)
    if case == "few":
        y, fy, ids = y[:5], fy[:5], ids[:5]
    x, fx = y[:n].copy(), fy[:n].copy()
    if case == "not finite":
        y[5], y[100] = np.nan, np.inf
    rows, cols, d2 = (np.concatenate(c) for c in zip(*neighbours._nearest(x, fx, y, fy, ids, k, digits)))
    for i in range(len(x)):
        z = np.zeros(len(y))
        with np.errstate(all="ignore"):
            for j in range(dim):
                z += (x[i, j] - y[:, j]) ** 2
        z = z if digits is None else neighbours._rounded(z, digits)
        order = np.lexsort((ids, z))
        order = order[(fy[order] != fx[i]) & np.isfinite(z[order])][:k]
        assert cols[rows == i].tolist() == order.tolist()
        assert (d2[rows == i] == z[order]).all()


def test_knn_graph_of_queries(spark, points):
    """the nearest of some queries, ties of rounded distances by id, without a join of all pairs."""
    got = {(r.a, r["rank"]): r.b for r in evaluate.nearest_of_all(points, 4, queries(points), 9).collect()}
    d = evaluate.squared_distances(points, queries(points)).withColumn("d2", F.round("d2", 9))
    assert got == {(r.a, r["rank"]): r.b for r in evaluate.nearest(d, 4).collect()}
    assert "NestedLoop" not in plan(catalog.QUERIES["knn_graph"](spark, SF))


def test_distances_of_queries(spark, points):
    """every pair once, rounded as SQL does, null where a vector is; no join of all pairs."""
    lost = points.unionByName(spark.createDataFrame([(400, None, 1), (401, None, 1)], points.schema))
    for p in (points, lost):
        got = {(r.a, r.b): r.distance for r in evaluate.distances(p, queries(p), 5, 9).collect()}
        want = evaluate.squared_distances(p, queries(p)).select("a", "b", F.round(F.sqrt(F.round("d2", 9)), 5).alias("d")).collect()
        assert got == {(r.a, r.b): r.d for r in want} and len(want) == len(got)
    assert "NestedLoop" not in plan(catalog.QUERIES["euclidean_distances"](spark, SF))


def test_silhouette_of_queries(spark, points):
    """as from a table of all pairs, also for points without label and alone in their class; no such table is made."""
    p = points.withColumn("label", F.when(~F.col("id").isin(5, 6), F.col("label")))
    got = {r.a: r.silhouette for r in evaluate.silhouette_of_all(p, queries(p)).collect()}
    want = {r.a: r.silhouette for r in evaluate.silhouette(evaluate.squared_distances(p, queries(p)), p).collect()}
    assert got == pytest.approx(want, abs=1e-9) and got[5] == 0 and got[80] == 0
    assert "NestedLoop" not in plan(catalog.QUERIES["silhouette"](spark, SF))


def test_scores_of_vectors(spark, points):
    """as from the long form, whose two joins held a row for every edge and place."""
    graph = evaluate.normalized_graph(evaluate.sparse_affinity(points, 4), "random_walk")
    got = {r.feature: r.score for r in evaluate.laplacian_scores_of_vectors(points, graph).collect()}
    long = points.select("id", F.posexplode("values").alias("feature", "value"))
    assert got == pytest.approx({r.feature: r.score for r in evaluate.laplacian_scores(long, graph).collect()}, abs=1e-9)
    assert "posexplode" not in plan(catalog.QUERIES["laplacian_score_sparse"](spark, SF))


def test_copies_by_blocks():
    """how often a point is sent does not grow with the input up to a block's size, and hardly beyond."""
    sent = {n: sum(neighbours.grid(n, n, 64, 20 * 160)) for n in (10_256, 102_560, 615_360)}
    assert max(sent.values()) <= 1.5 * sent[10_256] and max(sent.values()) < 25


def test_votes(spark):
    """votes are counted where the lists are; ties go to the smallest label, points without neighbours do not count."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 3))
    rows = [(i, [float(v) for v in x[i]], int(i % 3)) for i in range(60)]
    df = experiments.classifier(spark.createDataFrame(rows, "id long, values array<double>, label int"), [1, 2, 50])
    assert plan(df).count("Generate") == 2  # what deals points to blocks; no list is spread
    lists = spark.createDataFrame([(0, 1, [2, 1, 0]), (0, 2, [2, 2, 1]), (1, 1, [])], "fa int, la int, lb array<int>")
    of = lists.select("fa", F.col("la").cast("double").alias("la"), F.col("lb").cast("array<double>").alias("lb")).coalesce(1)
    got = {(r.k, r.fold): (r.good, r.n) for r in of.mapInArrow(experiments._votes([1, 3]), "k int, fold int, good long, n long").collect()}
    assert got == {(1, 0): (1, 2), (3, 0): (1, 2), (1, 1): (0, 0), (3, 1): (0, 0)}


@pytest.mark.parametrize("name", ["knn_batch_mixing", "knn_balanced_accuracy"])
def test_searched_once(spark, name):
    """F6, F8: statistics read stored lists; their plans hold no search."""
    assert "CoGroups" not in plan(catalog.QUERIES[name](spark, SF))


def test_split_reads_cells_once(spark):
    """parts read their own folder; no part makes the cells again."""
    made = spark.sparkContext.accumulator(0)
    see = F.udf(lambda v: (made.add(1), v)[1], "double")
    cells = spark.createDataFrame([(i, j, float(i + j)) for i in range(8) for j in range(3)], "row_id long, col_id long, value double")
    obs = spark.createDataFrame([(i, ["a", "", None, "b c/d"][i % 4]) for i in range(8)], "row_id long, batch string")
    m = CountMatrix(cells.select("row_id", "col_id", see("value").alias("value")), obs, cells.select("col_id").distinct())
    parts = algebra.split(m, "batch")
    got = {k: sorted(tuple(r) for r in p.cells.collect()) for k, p in parts.items()}
    assert got == {k: sorted((i, j, float(i + j)) for i in range(8) if i % 4 == n for j in range(3)) for k, n in (("", 1), ("a", 0), ("b c/d", 3))}
    assert made.value <= 24
    assert algebra.split(CountMatrix(cells, obs.where("batch IS NULL"), m.var), "batch") == {}


def test_linkage_asks_by_blocks(spark, monkeypatch):
    """points whose lists are swallowed are held against blocks that are as few as their size allows."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(30, 3)), rng.normal(size=(30, 3)) + 100])
    asked = []
    whole = neighbours.block_lists
    monkeypatch.setattr(neighbours, "block_lists", lambda *a, **k: (asked.append(a[0].count()), whole(*a, **k))[1])
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(60)], "id long, values array<double>")
    tree = linkage.spanning_tree(df).collect()
    assert len(tree) == 59 and sum((r.a < 30) != (r.b < 30) for r in tree) == 1
    assert len(asked) > 1 and asked[0] == 60
