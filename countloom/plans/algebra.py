"""Queries on arithmetic, comparison and assembly, graphs over all vectors, and annotations of several assays or layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from countloom.bundle import CountMatrix
from countloom.operators import algebra, evaluate, markers, normalise
from countloom.plans.catalog import DENSE, SM, UH, register, rounded, supplier_month, table, user_hour
from countloom.session import cut
from countloom.sources import modalities

# --- two matrices: lines of suppliers by month, the settled ones and the discounted ones

_TWO = "WITH a AS (SELECT l_suppkey AS row_id, strftime(l_shipdate, '%Y-%m') AS col_id, CAST(count(*) AS DOUBLE) AS x FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2), b AS (SELECT l_suppkey AS row_id, strftime(l_shipdate, '%Y-%m') AS col_id, CAST(count(*) AS DOUBLE) AS y FROM lineitem WHERE l_discount > 0.03 GROUP BY 1, 2), j AS (SELECT coalesce(a.row_id, b.row_id) AS row_id, coalesce(a.col_id, b.col_id) AS col_id, coalesce(x, 0.0) AS x, coalesce(y, 0.0) AS y FROM a FULL JOIN b ON a.row_id = b.row_id AND a.col_id = b.col_id)"


def _two(spark, d):
    lines = table(spark, d, "lineitem")
    keys = F.col("l_suppkey"), F.date_format("l_shipdate", "yyyy-MM")
    return tuple(CountMatrix.from_table(lines.where(c), *keys).cells for c in ("l_returnflag <> 'N'", "l_discount > 0.03"))


@register(_TWO + " SELECT row_id, col_id, x = y AS equal, x <> y AS not_equal, x > y AS greater, x < y AS less, x <= y AS less_equal FROM j")
def matrix_comparisons(spark, d):
    return algebra.compare(*_two(spark, d))


@register(_TWO + " SELECT row_id, col_id, x + 0.5 * y AS value FROM j")
def matrix_add_scaled(spark, d):
    return algebra.add(*_two(spark, d), 0.5)


@register(_TWO + " SELECT row_id, col_id, x - 2 * y AS value FROM j")
def matrix_subtract_scaled(spark, d):
    return algebra.subtract(*_two(spark, d), 2.0)


@register(_TWO + " SELECT bool_and(x = y) AS equal FROM j")
def matrices_all_equal(spark, d):
    return algebra.all_equal(*_two(spark, d))


@register(_TWO + " SELECT row_id, col_id, x AS value, 'settled' AS source FROM a UNION ALL SELECT row_id, col_id, y, 'discounted' FROM b")
def union_all(spark, d):
    a, b = _two(spark, d)
    return algebra.stack({"settled": a, "discounted": b})


@register("WITH o AS (SELECT o_custkey AS id, CAST(count(*) AS BIGINT) AS n_orders FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1), c AS (SELECT c_custkey AS id, c_mktsegment AS segment FROM customer WHERE c_acctbal > 0) SELECT coalesce(o.id, c.id) AS id, n_orders, segment FROM o FULL JOIN c ON o.id = c.id")
def concat_columns(spark, d):
    """Annotation tables side by side, rows met by id."""
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n_orders"))
    return algebra.concat_columns([o, table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))], "id")


@register("WITH n AS (SELECT o_custkey, max(o_totalprice) AS balance, max(o_orderdate) AS last FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) SELECT c_custkey AS id, coalesce(balance, c_acctbal) AS balance, c_mktsegment AS segment, last FROM customer LEFT JOIN n ON c_custkey = o_custkey")
def update_join_new_over_old(spark, d):
    new = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("balance"), F.max("o_orderdate").alias("last"))
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return algebra.updated(old, new, "id")


@register(SM + " SELECT n_regionkey AS batch, row_id, col_id, value FROM cells JOIN supplier ON row_id = s_suppkey JOIN nation ON s_nationkey = n_nationkey")
def split_by_annotation(spark, d):
    """A matrix of suppliers for each region, stacked again under the region's key."""
    region = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("row_id"), F.col("n_regionkey").alias("batch"))
    m = supplier_month(spark, d).settled()
    parts = algebra.split(CountMatrix(m.cells, m.obs.join(region, "row_id"), m.var), "batch")
    return algebra.stack({k: p.cells for k, p in parts.items()}, "batch")


@register(UH + DENSE + ", e AS (SELECT min(value) AS a, max(value) AS b FROM dense) SELECT row_id, col_id, round((value - a) / (b - a), 6) AS value FROM dense, e WHERE b > a")
def feature_scale_global(spark, d):
    return rounded(algebra.feature_scale(user_hour(spark, d)), "value")


@register(SM + " SELECT row_id, col_id, sum(value) OVER (PARTITION BY row_id ORDER BY col_id) AS value FROM cells")
def cumulative_sums(spark, d):
    return algebra.running_sum(supplier_month(spark, d).cells, F.col("col_id"))


@register(UH + DENSE + ", r AS (SELECT row_id, avg(value) AS rm FROM dense GROUP BY 1), c AS (SELECT col_id, avg(value) AS cm FROM dense GROUP BY 1), g AS (SELECT avg(value) AS gm FROM dense) SELECT row_id, col_id, round(2 * value - rm - cm + gm, 6) + 0.0 AS value FROM dense JOIN r USING (row_id) JOIN c USING (col_id), g")
def center_invert(spark, d):
    """The doubly centred matrix, doubled, with its means added again: 2 (x - c) + c."""
    m = user_hour(spark, d)
    twice = normalise.double_center(m).withColumn("value", 2 * F.col("value"))
    return rounded(normalise.uncenter(twice, normalise.centering(m)), "value")


# --- graphs: dense ones over 25 centroids, the sparse one over all vectors (in blocks)

from countloom.plans.evaluation import _C, _centroid_distances  # noqa: E402

_MUTUAL = _C + ", s AS (SELECT a, d2 AS s2 FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d2, b) AS r FROM d) WHERE r = 3), w AS (SELECT d.a, d.b, (exp(-d2 / x.s2) + exp(-d2 / y.s2)) / 2 AS w FROM d JOIN s x ON x.a = d.a JOIN s y ON y.a = d.b UNION ALL SELECT a, a, 1.0 FROM s), g AS (SELECT a, sum(w) AS d FROM w GROUP BY 1)"


def _mutual(spark, d):
    return evaluate.mutual_affinity(_centroid_distances(spark, d), 3)


@register(_MUTUAL + " SELECT a, b, round(w, 5) AS w FROM w")
def affinity_mutual(spark, d):
    return rounded(_mutual(spark, d), "w", digits=5)


@register(_MUTUAL + " SELECT w.a, w.b, round(w.w / sqrt(x.d * y.d), 5) AS p FROM w JOIN g x ON x.a = w.a JOIN g y ON y.a = w.b")
def graph_mutual_normalized(spark, d):
    return rounded(evaluate.normalized_graph(_mutual(spark, d)), "p", digits=5)


@register(_MUTUAL + " SELECT w.a, w.b, round(w.w / x.d, 5) AS p FROM w JOIN g x ON x.a = w.a")
def graph_random_walk(spark, d):
    return rounded(evaluate.normalized_graph(_mutual(spark, d), "random_walk"), "p", digits=5)


@register(_MUTUAL + " SELECT a, b, round(w, 5) AS p FROM w")
def graph_unnormalized(spark, d):
    return rounded(evaluate.normalized_graph(_mutual(spark, d), "unnormalized"), "p", digits=5)


_SPARSE = "WITH p AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), d AS (SELECT q.id AS a, p.id AS b, list_sum(list_transform(list_zip(q.v, p.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS d2 FROM p q JOIN p ON q.id <> p.id), nn AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d2, b) AS r FROM d), h AS (SELECT n.a, n.b, CASE WHEN s.d2 > 0 THEN exp(-n.d2 / s.d2) ELSE 1.0 END / 2 AS w FROM nn n JOIN nn s ON s.a = n.a AND s.r = 11 WHERE n.r <= 10), w AS (SELECT a, b, sum(w) AS w FROM (SELECT * FROM h UNION ALL SELECT b, a, w FROM h) GROUP BY 1, 2)"


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("values"))


@register(_SPARSE + " SELECT a, b, round(w, 5) AS w FROM w")
def affinity_sparse(spark, d):
    """The ten nearest of every vector."""
    return rounded(evaluate.sparse_affinity(_vectors(spark, d), 10), "w", digits=5)


@register(_SPARSE + ", g AS (SELECT a, sum(w) AS d FROM w GROUP BY 1), l AS (SELECT w.a, w.b, w.w / sqrt(x.d * y.d) AS p FROM w JOIN g x ON x.a = w.a JOIN g y ON y.a = w.b), x AS (SELECT id, generate_subscripts(v, 1) - 1 AS feature, unnest(v) AS value FROM p), o AS (SELECT feature, sum(value * value) AS o FROM x GROUP BY 1), c AS (SELECT xa.feature, sum(l.p * xa.value * xb.value) AS c FROM l JOIN x xa ON xa.id = l.a JOIN x xb ON xb.id = l.b AND xb.feature = xa.feature GROUP BY 1) SELECT CAST(o.feature AS INTEGER) AS feature, round(o - c, 4) + 0.0 AS score FROM o JOIN c USING (feature)")
def laplacian_score_sparse(spark, d):
    """Every dimension of the vectors over the graph of their ten nearest."""
    v = _vectors(spark, d)
    graph = evaluate.normalized_graph(cut(evaluate.sparse_affinity(v, 10), "affinity"))
    return rounded(evaluate.laplacian_scores_of_vectors(v, graph), "score", digits=4)


# --- several assays, several layers

_PAIR = "WITH c AS (SELECT user_id AS row_id, event_type AS col_id, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY 1, 2 UNION ALL SELECT user_id, 'peak-' || hour(ts), CAST(count(*) AS DOUBLE) FROM events GROUP BY 1, 2), x AS (SELECT *, starts_with(col_id, 'peak-') AS site, starts_with(col_id, 'c') AS mt FROM c)"


def _paired(spark, d):
    e = table(spark, d, "events")
    types = e.select(F.col("user_id"), F.col("event_type").alias("name"))
    hours = e.select("user_id", F.concat(F.lit("peak-"), F.hour("ts").cast("string")).alias("name"))
    m = CountMatrix.from_table(types.unionByName(hours), F.col("user_id"), F.col("name"))
    return modalities.annotate_paired(m, F.col("col_id").startswith("peak-"), F.col("col_id").startswith("c"))


@register(_PAIR + " SELECT row_id, count(*) FILTER (site) AS total_sites, coalesce(sum(value) FILTER (site), 0.0) AS total_peaks, count(*) FILTER (NOT site) AS total_genes, coalesce(sum(value) FILTER (NOT site), 0.0) AS \"total_UMIs\", coalesce(sum(value) FILTER (mt), 0.0) AS \"total_MT_UMIs\", round(coalesce(coalesce(sum(value) FILTER (mt), 0.0) / sum(value) FILTER (NOT site), 0.0), 6) AS \"pct_MT_UMIs\" FROM x GROUP BY 1")
def paired_assays_rows(spark, d):
    return rounded(_paired(spark, d)[0], "pct_MT_UMIs")


@register(_PAIR + " SELECT col_id, count(*) AS total_cells, sum(value) AS total_counts FROM x GROUP BY 1")
def paired_assays_columns(spark, d):
    return _paired(spark, d)[1]


@register("WITH x AS (SELECT l_suppkey AS row_id, l_quantity AS q, l_linenumber AS k, l_returnflag <> 'N' AS mapped, p_size < 10 AS mt FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT row_id, sum(q) AS total_reads, coalesce(sum(q) FILTER (mapped), 0.0) AS mapped_reads, coalesce(sum(q) FILTER (mapped AND mt), 0.0) AS \"MT_reads\", round(coalesce(sum(q) FILTER (mapped), 0.0) / sum(q), 6) AS pct_mapped_reads, round(coalesce(coalesce(sum(q) FILTER (mapped AND mt), 0.0) / sum(q) FILTER (mapped), 0.0), 6) AS \"pct_MT_reads\" FROM x GROUP BY 1")
def read_layer_annotations(spark, d):
    """Quantities as reads: all of them, those mapped, and those of small parts."""
    x = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    obs = x.groupBy(F.col("l_suppkey").alias("row_id")).agg(F.sum("l_quantity").alias("total_reads"))
    reads = CountMatrix.from_table(x.where("l_returnflag <> 'N'"), F.col("l_suppkey"), F.col("p_size"), F.col("l_quantity")).cells
    return rounded(modalities.annotate_reads(obs, reads, F.col("col_id") < 10), "pct_mapped_reads", "pct_MT_reads")


# --- statistics and markers

_Z = 1.959963984540054  # the normal quantile of 0.975
_TERMS = (_Z, (_Z**3 + _Z) / 4, (5 * _Z**5 + 16 * _Z**3 + 3 * _Z) / 96, (3 * _Z**7 + 19 * _Z**5 + 17 * _Z**3 - 15 * _Z) / 384, (79 * _Z**9 + 776 * _Z**7 + 1482 * _Z**5 - 1920 * _Z**3 - 945 * _Z) / 92160)
_T = "(" + " + ".join(f"CAST({g!r} AS DOUBLE) / pow(count(*) - 1, {i})" for i, g in enumerate(_TERMS)) + ")"


@register(f"SELECT CAST(day(o_orderdate) AS INTEGER) AS day, CAST(count(*) AS BIGINT) AS n, round(avg(o_totalprice), 4) AS mean, round({_T} * stddev_samp(o_totalprice) / sqrt(count(*)), 4) AS half_width FROM orders GROUP BY 1")
def mean_t_interval(spark, d):
    """Mean price by day of the month and its 95 % interval."""
    return rounded(evaluate.mean_t_interval(table(spark, d, "orders").withColumn("day", F.dayofmonth("o_orderdate")), ["day"], "o_totalprice"), "mean", "half_width", digits=4)


_LABELS = {"plain": ["STANDARD", "ECONOMY"], "sized": ["SMALL", "MEDIUM", "LARGE"]}
_MARK = "WITH x AS (SELECT DISTINCT upper(replace(p_brand, '-', '')) || p_size AS feature, CASE WHEN p_type IN ('STANDARD', 'ECONOMY') THEN 'plain' ELSE 'sized' END AS label FROM part WHERE p_type <> 'PROMO')"


def _markers(spark, d):
    listed = table(spark, d, "part").select(F.concat("p_brand", F.lit("-"), F.col("p_size").cast("string")).alias("name"), "p_type")
    return markers.from_lists(listed, "name", "p_type")


@register(_MARK + " SELECT feature, bool_or(label = 'plain') AS plain, bool_or(label = 'sized') AS sized FROM x GROUP BY 1")
def marker_flags(spark, d):
    """Brands and sizes of parts by the parts' types, under two labels."""
    return markers.flags(markers.mapped(_markers(spark, d), _LABELS), list(_LABELS))


@register(_MARK + " SELECT feature, min(label) AS label FROM x GROUP BY 1 HAVING count(*) = 1")
def marker_exclusive(spark, d):
    return markers.mapped(_markers(spark, d), _LABELS, exclusive=True)
