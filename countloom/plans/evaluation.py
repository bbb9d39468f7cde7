"""Queries on distances, neighbours, rank statistics and graphs.

Neighbour searches and ``silhouette`` take as queries every vector whose id is divisible by a stated number, against all
vectors; statistics of neighbours and ``silhouette_of_all`` are of every vector. Graph queries are over the class centroids or the stated
query set, so no table of all pairs of a corpus is made.
"""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from countloom.operators import evaluate, linkage, ranks
from countloom.plans.catalog import register, rounded, table

_STEP = 25
_E = f"WITH p AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings), q AS (SELECT * FROM p WHERE id % {_STEP} = 0)"
_ALL = _E.replace(f" WHERE id % {_STEP} = 0", "")  # statistics are of every point
_D = ", d AS (SELECT q.id AS a, p.id AS b, list_sum(list_transform(list_zip(q.v, p.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS d2 FROM q JOIN p ON q.id <> p.id)"
_NN = ", nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(d2, 9), b) AS rank FROM d) WHERE rank <= 10)"


def _points(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("values"), "label")


def _queries(p):
    return p.where(F.col("id") % _STEP == 0)


def _nn(spark, d):
    p = _points(spark, d)
    return evaluate.nearest_of_all(p, 10, _queries(p), digits=9)


def _nn_all(spark, d):
    return evaluate.nearest_of_all(_points(spark, d), 10, digits=9)


@register(_E + _D + " SELECT a, b, round(sqrt(d2), 5) AS distance FROM d")
def euclidean_distances(spark, d):
    p = _points(spark, d)
    return evaluate.distances(p, _queries(p), 5, 9)


@register(_E + _D + _NN + " SELECT a, b, CAST(rank AS INTEGER) AS rank FROM nn")
def knn_graph(spark, d):
    return _nn(spark, d).select("a", "b", "rank")


@register(_ALL + _D + _NN + " SELECT round(avg(CASE WHEN x.label = y.label THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM nn JOIN p x ON x.id = a JOIN p y ON y.id = b")
def knn_label_agreement(spark, d):
    return rounded(evaluate.agreement(_nn_all(spark, d), _points(spark, d)), "agreement")


_VOTES = ", votes AS (SELECT a, label, count(*) AS n FROM nn JOIN p ON p.id = b GROUP BY 1, 2), best AS (SELECT a, label AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, label) AS k FROM votes) WHERE k = 1)"


@register(_ALL + _D + _NN + _VOTES + " SELECT a, predicted FROM best")
def knn_majority_label(spark, d):
    return evaluate.majority(_nn_all(spark, d), _points(spark, d))


@register(_ALL + _D + _NN + _VOTES + " SELECT round(avg(r), 6) AS balanced_accuracy FROM (SELECT label, avg(CASE WHEN predicted = label THEN 1.0 ELSE 0.0 END) AS r FROM best JOIN p ON p.id = a GROUP BY 1)")
def knn_balanced_accuracy(spark, d):
    return rounded(evaluate.balanced_accuracy(evaluate.majority(_nn_all(spark, d), _points(spark, d)), _points(spark, d)), "balanced_accuracy")


@register(_ALL + _D + _NN + ", s AS (SELECT label, count(*) * 1.0 / (SELECT count(*) FROM p) AS share FROM p GROUP BY 1), g AS (SELECT a, s.label, share, (SELECT count(*) FROM nn x JOIN p ON p.id = x.b WHERE x.a = k.a AND p.label = s.label) AS seen FROM (SELECT DISTINCT a FROM nn) k CROSS JOIN s) SELECT a, round(sum((seen - 10 * share) * (seen - 10 * share) / (10 * share)), 6) AS chi2, sum((seen - 10 * share) * (seen - 10 * share) / (10 * share)) < 16.919 AS mixed FROM g GROUP BY 1")
def knn_batch_mixing(spark, d):
    p = _points(spark, d)
    return rounded(evaluate.mixing(_nn_all(spark, d), p, 16.919), "chi2")


@register(_E + _D + ", c AS (SELECT a, x.label AS la, y.label AS lb, avg(sqrt(round(d2, 9))) AS m FROM d JOIN p x ON x.id = a JOIN p y ON y.id = b GROUP BY 1, 2, 3), s AS (SELECT a, min(m) FILTER (la = lb) AS own, min(m) FILTER (la <> lb) AS other FROM c GROUP BY 1) SELECT a, CASE WHEN own IS NULL THEN 0.0 ELSE round((other - own) / greatest(own, other), 5) END AS silhouette FROM s")
def silhouette(spark, d):
    p = _points(spark, d)
    return rounded(evaluate.silhouette_of_all(p, _queries(p)), "silhouette", digits=5)


@register()
def silhouette_of_all(spark, d):
    """The silhouette of every vector against all others, of which ``silhouette`` has the stated query set."""
    return rounded(evaluate.silhouette_of_all(_points(spark, d)), "silhouette", digits=5)


_R = "WITH x AS (SELECT p_brand, p_size AS v, p_type LIKE '%BRASS' OR p_partkey % 3 = 0 AS pos FROM part), k AS (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY v) + (count(*) OVER (PARTITION BY p_brand, v) - 1) / 2.0 AS r FROM x), s AS (SELECT p_brand, sum(r) FILTER (pos) AS r, count(*) FILTER (pos) AS np, count(*) FILTER (NOT pos) AS nn FROM k GROUP BY 1)"


def _ranked(spark, d):
    pos = F.col("p_type").like("%BRASS") | (F.col("p_partkey") % 3 == 0)
    return table(spark, d, "part").select("p_brand", F.col("p_size").alias("v"), pos.alias("pos"))


@register(_R + " SELECT p_brand, CAST(np AS BIGINT) AS n_pos, CAST(nn AS BIGINT) AS n_neg, CAST(r - np * (np + 1) / 2.0 AS DOUBLE) AS u, round((r - np * (np + 1) / 2.0) / (np * nn), 6) AS auc FROM s")
def roc_auc_ranksum(spark, d):
    x = evaluate.auc(_ranked(spark, d), ["p_brand"], "v", "pos")
    return rounded(x.withColumn("u", F.col("u").cast("double")).withColumn("auc", F.col("auc").cast("double")), "auc")


@register(_R + ", t AS (SELECT p_brand, sum(CAST(c AS DOUBLE) * c * c - c) AS ties FROM (SELECT p_brand, v, count(*) AS c FROM x GROUP BY 1, 2) GROUP BY 1) SELECT p_brand, CAST(r - np * (np + 1) / 2.0 AS DOUBLE) AS u, round((r - np * (np + 1) / 2.0 - np * nn / 2.0) / sqrt(np * nn / 12.0 * (np + nn + 1 - ties / ((np + nn) * (np + nn - 1)))), 5) + 0.0 AS z FROM s JOIN t USING (p_brand)")
def mann_whitney_u(spark, d):
    x = evaluate.mann_whitney_z(_ranked(spark, d), ["p_brand"], "v", "pos")
    return rounded(x.withColumn("u", F.col("u").cast("double")), "z", digits=5)


_P = (
    _R + ", t AS (SELECT p_brand, sum(t * t * t - t) AS ties FROM (SELECT p_brand, v, count(*) AS t FROM x GROUP BY 1, 2) GROUP BY 1),"
    " z AS (SELECT p_brand, greatest(abs(r - np * (np + 1) / 2.0 - np * nn / 2.0) - 0.5, 0) / sqrt(np * nn / 12.0 * (np + nn + 1 - ties / ((np + nn) * (np + nn - 1)))) / sqrt(2.0) AS y FROM s JOIN t USING (p_brand)),"
    " e AS (SELECT p_brand, y, 1 / (1 + 0.3275911 * y) AS t FROM z)"
    " SELECT p_brand, round(least(1.0, count(*) OVER () * (((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t) * exp(-y * y)), 5) AS p_adjusted FROM e"
)


@register(_P)
def mann_whitney_p(spark, d):
    """p values times the number of brands."""
    return rounded(evaluate.mann_whitney_p(_ranked(spark, d), ["p_brand"], "v", "pos").drop("p"), "p_adjusted", digits=5)


@register("WITH q AS (" + _P.replace(" SELECT p_brand, round(", " SELECT p_brand, (").replace(", 5) AS p_adjusted", ") AS p_adjusted") + ") SELECT count(*) AS n_tests, count(*) FILTER (p_adjusted < 0.01) AS n_significant FROM q")
def significant_groups(spark, d):
    """How many adjusted p values fall below 0.01."""
    return evaluate.significant(evaluate.mann_whitney_p(_ranked(spark, d), ["p_brand"], "v", "pos"))


@register()
def balanced_auc(spark, d):
    """AUC with as many rows of either class in each group, by a keyed sample."""
    pos = F.col("p_type").like("%BRASS") | (F.col("p_partkey") % 3 == 0)
    x = table(spark, d, "part").select("p_brand", F.col("p_size").alias("v"), pos.alias("pos"), "p_partkey")
    return rounded(evaluate.balanced_auc(x, ["p_brand"], "v", "pos", "p_partkey"), "auc")


@register("SELECT p_brand, round(log2((1 + avg(p_retailprice) FILTER (p_size > 25)) / (1 + avg(p_retailprice) FILTER (p_size <= 25))), 6) + 0.0 AS log2fc FROM part GROUP BY 1")
def log2_fold_change(spark, d):
    hi, lo = (F.avg(F.when(c, F.col("p_retailprice"))) for c in (F.col("p_size") > 25, F.col("p_size") <= 25))
    return rounded(table(spark, d, "part").groupBy("p_brand").agg(F.log2((1 + hi) / (1 + lo)).alias("log2fc")), "log2fc")


@register("SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1")
def pearson_depth(spark, d):
    return rounded(table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.corr("l_quantity", "l_extendedprice").alias("r")), "r")


@register("WITH x AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS b FROM part) SELECT round(corr(a, b), 6) + 0.0 AS rho FROM x")
def spearman(spark, d):
    """Correlation of average ranks."""
    p = table(spark, d, "part").select("p_size", "p_retailprice")
    x = ranks.average_ranks(p, [], "p_size").withColumnRenamed("rank", "a")
    y = ranks.average_ranks(x, [], "p_retailprice").withColumnRenamed("rank", "b")
    return rounded(y.agg(F.corr("a", "b").alias("rho")), "rho")


# --- graphs over the centroids of suppliers' nations (25 points at most, whatever the scale)

_C = "WITH l AS (SELECT s_nationkey AS id, p_size % 10 AS feature, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), x AS (SELECT id, feature, n * 1.0 / sum(n) OVER (PARTITION BY id) AS value FROM l), k AS (SELECT a.id AS a, b.id AS b FROM (SELECT DISTINCT id FROM x) a JOIN (SELECT DISTINCT id FROM x) b ON a.id <> b.id), f AS (SELECT DISTINCT feature FROM x), d AS (SELECT k.a, k.b, sum(pow(coalesce(p.value, 0) - coalesce(q.value, 0), 2)) AS d2 FROM k CROSS JOIN f LEFT JOIN x p ON p.id = k.a AND p.feature = f.feature LEFT JOIN x q ON q.id = k.b AND q.feature = f.feature GROUP BY 1, 2)"


def _centroids(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    n = j.groupBy(F.col("s_nationkey").alias("id"), (F.col("p_size") % 10).alias("feature")).agg(F.count("*").alias("n"))
    return n.select("id", "feature", (F.col("n") / F.sum("n").over(Window.partitionBy("id"))).alias("value"))


def _centroid_distances(spark, d):
    x = _centroids(spark, d)
    held = x.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("h"))
    points = held.select("id", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda f: F.coalesce(F.try_element_at(F.col("h"), f), F.lit(0.0))).alias("values"))
    return evaluate.squared_distances(points, points)


@register(_C + " SELECT a, b, round(exp(-d2 / (2 * 0.02 * 0.02)), 5) AS w FROM d")
def affinity_gaussian(spark, d):
    return rounded(evaluate.gaussian_affinity(_centroid_distances(spark, d), 0.02), "w", digits=5)


_ADAPT = ", s AS (SELECT a, sqrt(d2) AS s FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d2, b) AS r FROM d) WHERE r = 3), w AS (SELECT d.a, d.b, exp(-d2 / (x.s * y.s)) AS w FROM d JOIN s x ON x.a = d.a JOIN s y ON y.a = d.b)"


@register(_C + _ADAPT + " SELECT a, b, round(w, 5) AS w FROM w")
def affinity_adaptive(spark, d):
    return rounded(evaluate.adaptive_affinity(_centroid_distances(spark, d), 3), "w", digits=5)


_GRAPH = _ADAPT + ", g AS (SELECT a, sum(w) AS d FROM w GROUP BY 1), p AS (SELECT w.a, w.b, w.w / sqrt(x.d * y.d) AS p FROM w JOIN g x ON x.a = w.a JOIN g y ON y.a = w.b)"


@register(_C + _GRAPH + " SELECT a, b, round(p, 5) AS p FROM p")
def graph_normalized(spark, d):
    return rounded(evaluate.normalized_graph(evaluate.adaptive_affinity(_centroid_distances(spark, d), 3)), "p", digits=5)


@register(_C + _GRAPH + ", o AS (SELECT feature, sum(value * value) AS o FROM x GROUP BY 1), c AS (SELECT xa.feature, sum(p.p * xa.value * xb.value) AS c FROM p JOIN x xa ON xa.id = p.a JOIN x xb ON xb.id = p.b AND xb.feature = xa.feature GROUP BY 1) SELECT o.feature, round(o - coalesce(c, 0), 6) + 0.0 AS score FROM o LEFT JOIN c USING (feature)")
def laplacian_score(spark, d):
    graph = evaluate.normalized_graph(evaluate.adaptive_affinity(_centroid_distances(spark, d), 3))
    return rounded(evaluate.laplacian_scores(_centroids(spark, d), graph), "score")


@register("WITH g AS (SELECT CAST(n_nationkey * 500.0 - 1000 AS DOUBLE) AS g FROM nation) SELECT g, round(avg(exp(-pow((g - c_acctbal) / 300.0, 2) / 2) / (300.0 * sqrt(2 * pi()))), 9) AS density FROM customer CROSS JOIN g GROUP BY 1")
def kde_grid(spark, d):
    grid = table(spark, d, "nation").select((F.col("n_nationkey") * 500.0 - 1000).alias("g"))
    return rounded(evaluate.kde(table(spark, d, "customer").select(F.col("c_acctbal").alias("x")), grid, 300.0), "density", digits=9)


@register("WITH g AS (SELECT CAST(n_nationkey * 500.0 - 1000 AS DOUBLE) AS g FROM nation), s AS (SELECT stddev_samp(c_acctbal) * pow(count(c_acctbal), -0.2) AS h FROM customer) SELECT g, round(avg(exp(-pow((g - c_acctbal) / h, 2) / 2) / (h * sqrt(2 * pi()))), 9) AS density FROM customer CROSS JOIN s CROSS JOIN g GROUP BY 1")
def kde_scott(spark, d):
    grid = table(spark, d, "nation").select((F.col("n_nationkey") * 500.0 - 1000).alias("g"))
    return rounded(evaluate.kde_scott(table(spark, d, "customer").select(F.col("c_acctbal").alias("x")), grid), "density", digits=9)


@register("SELECT p_brand, round(quantile_cont(p_retailprice, 0.25), 6) AS q1, round(quantile_cont(p_retailprice, 0.5), 6) AS q2, round(quantile_cont(p_retailprice, 0.75), 6) AS q3, min(p_retailprice) AS low, max(p_retailprice) AS high FROM part GROUP BY 1")
def box_statistics(spark, d):
    p = table(spark, d, "part")
    ends = p.groupBy("p_brand").agg(F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"))
    return rounded(ranks.quantiles(p, ["p_brand"], "p_retailprice", [0.25, 0.5, 0.75]).join(ends, "p_brand"), "q1", "q2", "q3")


@register("SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, round(1.959963984540054 * stddev_samp(l_quantity) / sqrt(count(*)), 6) AS half_width FROM lineitem GROUP BY 1")
def mean_interval(spark, d):
    h = 1.959963984540054 * F.stddev_samp("l_quantity") / F.sqrt(F.count("*"))
    return rounded(table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.avg("l_quantity").alias("mean"), h.alias("half_width")), "mean", "half_width")


@register("SELECT c_mktsegment, c_custkey, CAST((row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) - 1) * 1.0 / count(*) OVER (PARTITION BY c_mktsegment) AS DOUBLE) AS cdf FROM customer")
def rank_as_cdf(spark, d):
    c = table(spark, d, "customer").select("c_mktsegment", "c_custkey", "c_acctbal")
    n = c.groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return ranks.numbered(c, ["c_mktsegment"], ["c_acctbal", "c_custkey"]).join(n, "c_mktsegment").select("c_mktsegment", "c_custkey", (F.col("number") / F.col("n")).alias("cdf"))


@register("WITH m AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.5) AS med FROM orders GROUP BY 1) SELECT o_orderpriority, round(any_value(med), 6) AS median, round(quantile_cont(abs(o_totalprice - med), 0.5) / 0.6744897501960817, 6) AS mad FROM orders JOIN m USING (o_orderpriority) GROUP BY 1")
def median_mad(spark, d):
    o = table(spark, d, "orders")
    m = ranks.quantiles(o, ["o_orderpriority"], "o_totalprice", [0.5], ["median"])
    x = o.join(m, "o_orderpriority").select("o_orderpriority", F.abs(F.col("o_totalprice") - F.col("median")).alias("off"))
    mad = ranks.quantiles(x, ["o_orderpriority"], "off", [0.5], ["off"])
    return rounded(m.join(mad, "o_orderpriority").select("o_orderpriority", "median", (F.col("off") / 0.6744897501960817).alias("mad")), "median", "mad")


@register()
def single_linkage(spark, d):
    """Merges of all vectors by single linkage."""
    return rounded(linkage.single_linkage(_points(spark, d))[0], "height", digits=9)


@register()
def linkage_leaves(spark, d):
    """The order of leaves under single linkage."""
    return linkage.single_linkage(_points(spark, d))[1]
