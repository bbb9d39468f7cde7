"""Ranks, running sums, quantiles and quotas over ranges, against pandas and NumPy."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from countloom.operators import evaluate, ranks, sampling


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    out = [(rnd.choice("aab"), float(rnd.randrange(12)), i, rnd.random() < 0.3) for i in range(600)]
    out += [("a", 5.0, 600 + i, i % 2 == 0) for i in range(400)]  # a hot value in a hot group
    out += [(None, float(i % 7), 1000 + i, True) for i in range(50)] + [("c", 1.0, 2000, True), ("b", None, 2001, True)]
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "g string, v double, id long, p boolean").repartition(7).persist()


def group(x):
    return "" if x is None else x


def test_average_ranks(df, rows):
    got = {r["id"]: r["rank"] for r in ranks.average_ranks(df, ["g"], "v").collect()}
    x = pd.DataFrame(rows, columns=["g", "v", "id", "p"]).dropna(subset=["v"])
    want = dict(zip(x.id, x.groupby(x.g.map(group)).v.rank()))
    assert got == want
    whole = {r["id"]: r["rank"] for r in ranks.average_ranks(df, [], "v").collect()}
    assert whole == dict(zip(x.id, x.v.rank()))


def test_numbered_in_many_ranges(spark, df, rows):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = sorted((group(r["g"]), r["number"], r["id"]) for r in ranks.numbered(df, ["g"], ["v", "id"]).collect())
        sums = {(group(r["g"]), r["v"], r["id"]): r["before_x"] for r in ranks.cumulative(df.withColumn("x", F.col("id") * 0.5), ["g"], ["v", "id"], ["x"]).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[0])
        spark.conf.set("spark.sql.shuffle.partitions", before[1])
    want, total, last = [], 0.0, None
    for g, none, v, i in sorted((group(g), v is not None, v or 0.0, i) for g, v, i, _ in rows):
        n, total = (0, 0.0) if g != last else (n + 1, total)  # noqa: F821
        last = g
        want.append((g, n, i))
        assert sums[g, v if none else None, i] == total
        total += i * 0.5
    assert got == want


def test_quantiles(spark, df, rows):
    qs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    for known in (None, 10):
        got = {r[0]: list(r[1:]) for r in ranks.quantiles(df, ["g"], "v", qs, rows=known).collect()}
        for g in ("a", "b", "c", None):
            assert got[g] == pytest.approx(np.quantile([v for h, v, *_ in rows if h == g and v is not None], qs))
        assert list(ranks.quantiles(df, [], "v", qs, rows=known).first()) == pytest.approx(np.quantile([r[1] for r in rows if r[1] is not None], qs))
        assert ranks.quantiles(df.limit(0), ["g"], "v", qs, rows=known).count() == 0
        assert list(ranks.quantiles(df.limit(0), [], "v", [0.5], rows=known).first()) == [None]


def test_auc(df, rows):
    got = {r["g"]: r for r in evaluate.auc(df, ["g"], "v", "p").collect()}
    for g in ("a", "b"):
        pos, neg = ([v for h, v, _, p in rows if h == g and v is not None and p == want] for want in (True, False))
        u = sum((x > y) + 0.5 * (x == y) for x in pos for y in neg)
        assert got[g]["u"] == u and got[g]["auc"] == pytest.approx(u / len(pos) / len(neg))
    assert got["c"]["auc"] is None


def test_balanced_auc(df, rows):
    got = [{r["g"]: tuple(r) for r in evaluate.balanced_auc(x, ["g"], "v", "p", "id").collect()} for x in (df, df.repartition(3))]
    assert got[0] == got[1]
    for g in ("a", "b"):
        fewer = min(sum(1 for r in rows if r[0] == g and r[1] is not None and r[3] == p) for p in (True, False))
        assert got[0][g][1:3] == (fewer, fewer)
    assert evaluate.balanced_auc(df, ["g"], "v", "p", "id", seed=1).where("g = 'a'").first()["auc"] != got[0]["a"][4]


def test_quota_and_top_up(spark):
    rows = [(g, s, i * 100 + ord(s)) for g in "xy" for s, n in (("a", 3), ("b", 40), ("c", 80)) for i in range(n) if g == "x" or s != "b"]
    df = spark.createDataFrame([(g, s, f"{g}{i}") for g, s, i in rows], "g string, s string, id string").repartition(5)
    got = sampling.with_top_up(df, "g", "s", 30, "id").collect()
    n = {(g, s): sum(1 for r in got if (r["g"], r["s"]) == (g, s)) for g, s, _ in rows}
    assert sum(v for (g, _), v in n.items() if g == "x") == 30 == sum(v for (g, _), v in n.items() if g == "y")
    assert n["x", "a"] == 3 and n["y", "a"] == 3 and n["y", "c"] == 27 and n["x", "b"] >= 10 and n["x", "c"] >= 10
    assert sum(1 for r in got if r["g"] == "x" and r["pass"] == 1) == 23
    assert sorted(got) == sorted(sampling.with_top_up(df.repartition(2), "g", "s", 30, "id").collect())
    assert sampling.with_top_up(df, "g", "s", 1000, "id").count() == len(rows)


def test_scott_bandwidth(spark):
    grid = spark.createDataFrame([(0.0,), (1.5,)], "g double")
    x = np.array([0.0, 1.0, 1.0, 4.0, 9.0])
    h = x.std(ddof=1) * len(x) ** -0.2
    got = {r["g"]: r["density"] for r in evaluate.kde_scott(spark.createDataFrame([(v, 1.0) for v in x.tolist()] + [(None, 1.0)], "x double, h double"), grid).collect()}
    for g, v in got.items():
        assert v == pytest.approx(np.exp(-(((g - x) / h) ** 2) / 2).mean() / (h * np.sqrt(2 * np.pi)))
    assert len(got) == 2
    for rows in ([(3.0,), (3.0,)], [(3.0,)]):
        assert all(r["density"] is None for r in evaluate.kde_scott(spark.createDataFrame(rows, "x double"), grid).collect())
