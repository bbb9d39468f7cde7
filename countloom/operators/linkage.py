"""Single linkage: a minimum spanning tree by rounds of nearest neighbours, its merges in order, and the order of leaves.

The tree comes from Boruvka's rounds: every component takes its least edge to another one, so components at least halve. A point keeps its
nearest few others; as components only grow, the first of them that is still outside remains the nearest outside. A point whose whole list has been
swallowed is asked again only where the end of its list is no farther than the least edge its component has already. Edges are ordered by
(distance, ids), so ties make no cycles and every run gives the same tree.

Merges follow the sorted edges in levels of a bounded number of edges. A level is one small task: it sees the clusters its edges touch, not
their points. The points' clusters and places are then moved by a join with what the level says.

The search for neighbours is what costs: cells where points are clustered, all pairs in blocks where they are not, and blocks of the points
that are asked again against all.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from countloom.operators import evaluate, neighbours, ranks
from countloom.session import cut

#: Nearest others that a point keeps; edges of a level (about 10 MB in its task, and in the moves that it broadcasts).
KNOWN, LEVEL = 8, 1 << 17
_STEP = "step long, a long, b long, d2 double, left long, right long, size long, shift long"


def spanning_tree(points: DataFrame) -> DataFrame:
    """(a, b, d2), a < b: the edges of the minimum spanning tree of ``points`` (id, values), ties by ids.

    Points without id or values belong to no tree; other columns are not looked at. Ids that repeat raise. Fewer than two points have no edges.
    """
    p = points.select(F.col("id").cast("long").alias("id"), F.col("values").cast("array<double>").alias("values")).dropna()
    p = cut(p, "points")
    if not p.groupBy("id").count().where("count > 1").isEmpty():
        raise ValueError("ids repeat")
    components = p.count()
    comp = p.select("id", F.col("id").alias("comp"))
    each = p.select("id", "values", F.lit(0).alias("label"), F.col("id").alias("fold"))
    near = cut(evaluate._nearest_lists(each, KNOWN), "nearest")
    pairs, ends = _known(near)
    outside = pairs.withColumns({"ca": F.col("a"), "cb": F.col("b")})  # every point is a component
    tree = []
    while components > 1:
        if tree:
            outside, ends = _outside(p, comp, pairs, ends)
            pairs = outside.select("a", "b", "d2")
        least = cut(outside.groupBy("ca").agg(F.min(F.struct("d2", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cb")).alias("e")), "least")
        tree.append(least.select("e.a", "e.b", "e.d2").distinct())
        top = _tops(least.select(F.col("ca").alias("comp"), F.col("e.cb").alias("top")), components)
        comp = cut(comp.join(top, "comp").select("id", F.col("top").alias("comp")), "components")
        components = top.where("comp = top").count()
    out = p.sparkSession.createDataFrame([], "a long, b long, d2 double")
    for edges in tree:
        out = out.unionByName(edges)
    return out


def _known(near: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b, d2) of lists, and where a list ends (a, end) that may have gone on."""
    pairs = near.select("a", F.explode("near").alias("n")).select("a", "n.b", "n.d2")
    return pairs, near.where(F.size("near") == KNOWN).select("a", F.element_at(F.col("near")["d2"], -1).alias("end"))


def _outside(p: DataFrame, comp: DataFrame, pairs: DataFrame, ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b, d2, ca, cb): known pairs of different components, with a new list for every point that may hold its component's least edge; and the ends."""

    def split(x: DataFrame) -> DataFrame:
        of = lambda side: comp.select(F.col("id").alias(side), F.col("comp").alias(f"c{side}"))
        return x.join(of("a"), "a").join(of("b"), "b").where("ca <> cb").select("a", "b", "d2", "ca", "cb")

    held = cut(split(pairs), "outside")
    least = held.groupBy(F.col("ca").alias("comp")).agg(F.min("d2").alias("least"))
    lost = ends.join(held.select("a").distinct(), "a", "left_anti").withColumnRenamed("a", "id").join(comp, "id").join(least, "comp", "left")
    ask = cut(lost.where(F.col("least").isNull() | (F.col("end") <= F.col("least"))).select("id"), "asked")
    if ask.isEmpty():
        return held, ends
    whole = cut(p.join(comp, "id").select("id", "values", F.lit(0).alias("label"), F.col("comp").alias("fold")), "points")
    asked = cut(whole.join(ask, "id", "left_semi"), "asked")
    found = cut(neighbours.block_lists(asked, whole, KNOWN), "found")
    new, new_ends = _known(found)
    ends = cut(ends.join(ask.select(F.col("id").alias("a")), "a", "left_anti").unionByName(new_ends), "ends")
    return cut(held.unionByName(split(new)), "outside"), ends


def _ends(up: pa.Table) -> pa.Table:
    comp = up.column("comp").to_pylist()
    to = dict(zip(comp, up.column("top").to_pylist()))
    to.update({c: c for c in comp if c < to[c] and to[to[c]] == c})
    for c in comp:
        path = [c]
        while to[path[-1]] != path[-1]:
            path.append(to[path[-1]])
        for x in path:
            to[x] = path[-1]
    return pa.table({"comp": pa.array(comp, pa.int64()), "top": pa.array([to[c] for c in comp], pa.int64())})


def _tops(up: DataFrame, n: int) -> DataFrame:
    """(comp, top) of ``n`` components from (comp, top) one step up, where two that point at each other end at the smaller.

    By joins of doubled steps; no more than LEVEL are followed in one small task.
    """
    if n <= LEVEL:
        return cut(up.withColumn("level", F.lit(0)).groupBy("level").applyInArrow(_ends, "comp long, top long"), "up")
    back = up.select(F.col("comp").alias("top"), F.col("top").alias("back"))
    ends = (F.col("back") == F.col("comp")) & (F.col("comp") < F.col("top"))
    up = cut(up.join(back, "top").select("comp", F.when(ends, F.col("comp")).otherwise(F.col("top")).alias("top")), "up")
    while True:
        on = up.select(F.col("comp").alias("top"), F.col("top").alias("next"))
        up = cut(up.join(on, "top").select("comp", F.col("next").alias("top"), (F.col("next") != F.col("top")).alias("moved")), "up")
        if up.where("moved").isEmpty():
            return up.select("comp", "top")
        up = up.select("comp", "top")


def _merge(edges: pa.Table) -> pa.Table:
    """A level's merges in order (step set), then where each cluster it touched has gone (step null: left is the cluster, right its new name)."""
    edges = edges.sort_by("step")
    parent: dict[int, int] = {}
    shift: dict[int, int] = {}
    size: dict[int, int] = {}
    for c, n in (("ca", "na"), ("cb", "nb")):
        size.update(zip(edges.column(c).to_pylist(), edges.column(n).to_pylist()))

    def find(c: int) -> int:
        path = []
        while c in parent:
            path.append(c)
            c = parent[c]
        total = 0
        for x in reversed(path):
            total += shift[x]
            parent[x], shift[x] = c, total
        return c

    rows = []
    for step, a, b, d2, ca, cb in zip(*(edges.column(c).to_pylist() for c in ("step", "a", "b", "d2", "ca", "cb"))):
        left, right = sorted((find(ca), find(cb)))
        parent[right], shift[right] = left, size[left]
        size[left] += size[right]
        rows.append((step, a, b, d2, left, right, size[left], None))
    for c in list(size):
        top = find(c)
        rows.append((None, None, None, None, c, top, size[top], shift.get(c, 0)))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    return pa.table([pa.array(col, kind) for col, kind in zip(zip(*rows), kinds)], names=[f.split()[0] for f in _STEP.split(", ")])


def single_linkage(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The merges (step, a, b, left, right, height, size) and the leaves (id, place) of ``points`` (id, values).

    Step from 0 by (height, a, b); a and b are the points whose edge joins the clusters ``left`` and ``right``, which go by their smallest id
    (left < right); ``size`` counts the points of both. In the order of leaves every cluster is one run, left before right.
    Points without id or values are in neither table; a single point is a leaf at place 0.
    """
    tree = cut(ranks.numbered(cut(spanning_tree(points), "tree"), [], ["d2", "a", "b"], "step"), "edges")
    at = cut(points.select(F.col("id").cast("long").alias("id"), "values").dropna().select("id", F.col("id").alias("cluster"), F.lit(0).cast("long").alias("place"), F.lit(1).cast("long").alias("n")), "leaves")
    merges = tree.sparkSession.createDataFrame([], _STEP)
    for first in range(0, tree.count(), LEVEL):
        edges = tree.where((F.col("step") >= first) & (F.col("step") < first + LEVEL)).withColumn("level", F.lit(first))
        for side in "ab":
            edges = edges.join(at.select(F.col("id").alias(side), F.col("cluster").alias(f"c{side}"), F.col("n").alias(f"n{side}")), side)
        done = cut(edges.groupBy("level").applyInArrow(_merge, _STEP), "merges")  # at most LEVEL rows
        merges = merges.unionByName(done.where("step IS NOT NULL"))
        moves = done.where("step IS NULL").select(F.col("left").alias("cluster"), F.col("right").alias("to"), F.col("size").alias("m"), "shift")
        moved = at.join(F.broadcast(moves), "cluster", "left")  # at most two rows an edge
        at = cut(moved.select("id", F.coalesce("to", "cluster").alias("cluster"), (F.col("place") + F.coalesce("shift", F.lit(0))).alias("place"), F.coalesce("m", "n").alias("n")), "leaves")
    return merges.select("step", "a", "b", "left", "right", F.sqrt("d2").alias("height"), "size"), at.select("id", "place")
