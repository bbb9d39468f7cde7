"""Single linkage against a plain agglomeration in NumPy."""

import numpy as np
import pytest

from countloom.operators import linkage

POINT = "id long, values array<double>"


def brute(ids, x):
    """Merges (height, size) in order, clusters (sets of ids) as they arise, by the closest pair of clusters each time."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    sets = [{i} for i in ids]
    d[np.arange(len(x)), np.arange(len(x))] = np.inf
    heights, sizes, arisen = [], [], []
    while len(sets) > 1:
        i, j = sorted(np.unravel_index(d.argmin(), d.shape))
        heights.append(d[i, j])
        sets[i] = sets[i] | sets[j]
        d[i] = np.minimum(d[i], d[j])
        d[:, i] = d[i]
        d[i, i] = np.inf
        d = np.delete(np.delete(d, j, 0), j, 1)
        del sets[j]
        sizes.append(len(sets[i]))
        arisen.append(sets[i])
    return heights, sizes, arisen


@pytest.mark.parametrize("case", ["noise", "clusters", "ties", "copies"])
def test_merges_and_leaves(spark, case, monkeypatch):
    monkeypatch.setattr(linkage, "LEVEL", 150)
    rng = np.random.default_rng(8)
    n = 500 if case in ("noise", "clusters") else 120
    x = rng.normal(size=(n, 3))
    if case == "clusters":
        x += 50 * rng.normal(size=(6, 3))[rng.integers(0, 6, n)]  # lists end inside a cluster, so points are asked again
    if case == "ties":
        x = rng.integers(0, 6, (n, 3)).astype(float)
    if case == "copies":
        x[:80] = x[0]
    ids = rng.permutation(n) * 3
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], POINT).repartition(3)
    merges, leaves = linkage.single_linkage(df)
    rows = sorted(merges.collect(), key=lambda r: r["step"])
    heights, sizes, arisen = brute([int(i) for i in ids], x)
    assert [r["step"] for r in rows] == list(range(n - 1))
    assert [r["height"] for r in rows] == pytest.approx(heights, rel=1e-9, abs=1e-9)
    if case in ("noise", "clusters"):
        assert [r["size"] for r in rows] == sizes
    place = {r["id"]: r["place"] for r in leaves.collect()}
    assert sorted(place.values()) == list(range(n)) and set(place) == {int(i) for i in ids}
    sets = {int(i): {int(i)} for i in ids}
    for r in rows:  # clusters go by their smallest id, and are runs of leaves
        left, right = sets[r["left"]], sets.pop(r["right"])
        assert r["left"] == min(left) < r["right"] == min(right)
        assert len({r["a"], r["b"]} & left) == len({r["a"], r["b"]} & right) == 1
        assert max(place[i] for i in left) + 1 == min(place[i] for i in right)
        left |= right
        assert r["size"] == len(left) == max(place[i] for i in left) - min(place[i] for i in left) + 1
    if case == "noise":
        last = [s for s in arisen if len(s) == n]
        assert last and last[0] == set(place)


def test_queries(spark):
    """Both queries on the whole smallest table."""
    from countloom.plans.catalog import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    heights, _, _ = brute([r[0] for r in rows], np.array([r[1] for r in rows], float))
    merges = QUERIES["single_linkage"](spark, sf).orderBy("step").collect()
    assert [r["height"] for r in merges] == pytest.approx(heights, abs=1e-8)
    place = {r["id"]: r["place"] for r in QUERIES["linkage_leaves"](spark, sf).collect()}
    assert set(place) == {r[0] for r in rows} and sorted(place.values()) == list(range(len(rows)))
    sets = {i: [i] for i in place}
    for r in merges:
        sets[r["left"]] += sets.pop(r["right"])
    (order,) = sets.values()
    assert [place[i] for i in order] == list(range(len(rows)))


def test_edges_of_the_input(spark):
    empty = spark.createDataFrame([], POINT)
    assert [t.count() for t in linkage.single_linkage(empty)] == [0, 0]
    merges, leaves = linkage.single_linkage(spark.createDataFrame([(4, [1.0]), (5, None), (None, [2.0])], POINT))
    assert merges.count() == 0 and [tuple(r) for r in leaves.collect()] == [(4, 0)]
    with pytest.raises(ValueError):
        linkage.single_linkage(spark.createDataFrame([(4, [1.0]), (4, [2.0])], POINT))
    extra = spark.createDataFrame([(1, [0.0], 7, 8), (2, [3.0], 7, 8), (9, [4.0], 7, 8)], POINT + ", comp long, top long")
    merges, leaves = linkage.single_linkage(extra)
    assert [(r["left"], r["right"], r["height"], r["size"]) for r in merges.orderBy("step").collect()] == [(2, 9, 1.0, 2), (1, 2, 3.0, 3)]
    assert {r["id"]: r["place"] for r in leaves.collect()} == {1: 0, 2: 1, 9: 2}
