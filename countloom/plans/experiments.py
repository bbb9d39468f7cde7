"""Queries for experiment tables, modalities and quality pipelines."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from countloom.operators import experiments as X, normalise, ranks
from countloom.bundle import CountMatrix
from countloom.plans.catalog import CM, DENSE, SM, UE, UH, customer_month, register, rounded, supplier_brand, supplier_month, table, user_event, user_hour
from countloom.sources import modalities

_SPATIAL = ", o AS (SELECT row_id, sum(value) AS total_counts, CAST(count(*) AS BIGINT) AS total_genes FROM cells GROUP BY 1)"


@register(CM + _SPATIAL + " SELECT row_id, total_counts, total_genes FROM o")
def modality_annotations(spark, d):
    return modalities.SPATIAL.annotate(customer_month(spark, d))[0].select("row_id", "total_counts", "total_genes")


@register(UE + " SELECT row_id, sum(value) AS total_UMIs, CAST(count(*) AS BIGINT) AS total_genes, sum(CASE WHEN starts_with(col_id, 'c') THEN value ELSE 0.0 END) AS total_MT_UMIs, round(sum(CASE WHEN starts_with(col_id, 'c') THEN value ELSE 0.0 END) / sum(value), 6) AS pct_MT_UMIs FROM cells GROUP BY 1")
def modality_subset_share(spark, d):
    o, _ = modalities.EXPRESSION.annotate(user_event(spark, d), F.col("col_id").startswith("c"))
    return rounded(o, "pct_MT_UMIs")


@register(CM + ", g AS (SELECT row_id, count(*) AS n FROM cells GROUP BY 1), f AS (SELECT col_id, count(*) AS n FROM cells GROUP BY 1) SELECT x.row_id, x.col_id, x.value FROM cells x JOIN g USING (row_id) JOIN f USING (col_id) WHERE g.n >= 5 AND g.n < 14 AND f.n >= 10 AND f.n < 100000")
def quality_pipeline(spark, d):
    """Cells and columns with enough and not too many detections (upper limits are strict)."""
    m = customer_month(spark, d)
    g = m.cells.groupBy("row_id").agg(F.count("*").alias("n")).where("n >= 5 AND n < 14")
    f = m.cells.groupBy("col_id").agg(F.count("*").alias("n")).where("n >= 10 AND n < 100000")
    return m.submatrix(g, f).cells


@register(UH + DENSE + ", t AS (SELECT row_id, sum(value) AS c FROM cells GROUP BY 1), x AS (SELECT row_id, col_id, value, c FROM dense JOIN t USING (row_id)), s AS (SELECT col_id, covar_samp(value, c) / var_samp(c) AS slope, avg(value) AS mv, avg(c) AS mc FROM x GROUP BY 1) SELECT row_id, col_id, round(value - mv - slope * (c - mc), 5) + 0.0 AS value FROM x JOIN s USING (col_id)")
def regress_out(spark, d):
    m = user_hour(spark, d)
    return rounded(X.regress_out(m, m.cells.groupBy("row_id").agg(F.sum("value").alias("c"))), "value", digits=5)


@register(
    UH + DENSE + ", t AS (SELECT row_id, sum(value) AS c, CAST(row_id % 7 AS DOUBLE) AS e FROM cells GROUP BY 1), a AS (SELECT avg(c) AS mc, avg(e) AS me, var_pop(c) AS cc, var_pop(e) AS ee, covar_pop(c, e) AS ce FROM t),"
    " x AS (SELECT row_id, col_id, value, c - mc AS c, e - me AS e FROM dense JOIN t USING (row_id) CROSS JOIN a), s AS (SELECT col_id, avg(value) AS mv, covar_pop(value, c) AS xc, covar_pop(value, e) AS xe FROM x GROUP BY 1)"
    " SELECT row_id, col_id, round(value - mv - c * (xc * ee - xe * ce) / (cc * ee - ce * ce) - e * (xe * cc - xc * ce) / (cc * ee - ce * ce), 5) + 0.0 AS value FROM x JOIN s USING (col_id) CROSS JOIN a"
)
def regress_out_covariates(spark, d):
    """Two covariates at once, and one that both of them determine."""
    m = user_hour(spark, d)
    c = m.cells.groupBy("row_id").agg(F.sum("value").alias("c")).withColumn("e", (F.col("row_id") % 7).cast("double"))
    return rounded(X.regress_out(m, c.withColumn("both", F.col("c") - 2 * F.col("e"))), "value", digits=5)


@register(CM + DENSE + ", s AS (SELECT col_id, avg(value) AS mean, stddev_pop(value) AS sd FROM dense GROUP BY 1) SELECT row_id, col_id, round(least((value - mean) / CASE WHEN sd < 1e-12 THEN 1 ELSE sd END, 2.0), 6) + 0.0 AS value FROM dense JOIN s USING (col_id)")
def scaled_with_limit(spark, d):
    return rounded(X.scaled(normalise.zscore(customer_month(spark, d)), 2.0), "value")


@register(SM + ", t AS (SELECT col_id, abs(quantile_cont(value, 0.3)) AS t FROM cells GROUP BY 1) SELECT row_id, col_id, value FROM cells JOIN t USING (col_id) WHERE value > t")
def truncate_quantile(spark, d):
    return X.truncate_quantile(supplier_month(spark, d).cells, 0.3).select("row_id", "col_id", "value")


@register(SM + ", r AS (SELECT row_id, s_nationkey % 4 AS region FROM obs JOIN supplier ON row_id = s_suppkey) SELECT region, col_id, round(avg(value), 6) AS mean FROM cells JOIN r USING (row_id) GROUP BY 1, 2")
def two_level_means(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("row_id"), (F.col("s_nationkey") % 4).alias("region"))
    return rounded(supplier_month(spark, d).cells.join(s, "row_id").groupBy("region", "col_id").agg(F.avg("value").alias("mean")), "mean")


@register("WITH x AS (SELECT a.c_nationkey AS i, b.s_nationkey AS j, count(*) AS n FROM orders JOIN customer a ON o_custkey = a.c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier b ON l_suppkey = b.s_suppkey GROUP BY 1, 2) SELECT p.n_regionkey AS \"left\", q.n_regionkey AS \"right\", CAST(sum(n) AS DOUBLE) AS value FROM x JOIN nation p ON p.n_nationkey = i JOIN nation q ON q.n_nationkey = j WHERE p.n_regionkey < q.n_regionkey GROUP BY 1, 2")
def block_pair_sums(spark, d):
    """Contacts between pairs of regions, off the diagonal."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("row_id"))
    i = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", F.col("s_nationkey").alias("col_id"))
    cells = o.join(i, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("row_id", "col_id").agg(F.count("*").cast("double").alias("value"))
    regions = table(spark, d, "nation").select(F.col("n_nationkey").alias("bin_id"), F.col("n_regionkey").alias("region"))
    return X.block_pairs(cells, regions).groupBy("left", "right").agg(F.sum("value").alias("value"))


@register("SELECT vec_id AS id, CASE WHEN vec_id % 2 = 0 THEN coalesce(CASE label WHEN 0 THEN 'zero' WHEN 1 THEN 'one' END, CAST(label AS VARCHAR)) ELSE CAST(label AS VARCHAR) END AS label FROM embeddings")
def masked_relabel(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return X.relabelled(e, {0: "zero", 1: "one"}, F.col("id") % 2 == 0)


@register("SELECT p_brand, bool_or(regexp_matches(upper(p_type), 'BRASS|STEEL')) AS hit, CAST(sum(CASE WHEN regexp_matches(p_name, '[aeiou]{2}') THEN 1 ELSE 0 END) AS BIGINT) AS n FROM part GROUP BY 1")
def regex_hits(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.bool_or(F.upper("p_type").rlike("BRASS|STEEL")).alias("hit"), F.sum(F.when(F.col("p_name").rlike("[aeiou]{2}"), 1).otherwise(0)).alias("n"))


@register("WITH x AS (SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer) SELECT k, c_acctbal AS value FROM x WHERE k IN (1, 10, 100)")
def kth_largest(spark, d):
    """The 1st, 10th and 100th largest value: a bounded top-k, then its places."""
    top = table(spark, d, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(100)
    k = top.withColumn("k", F.row_number().over(Window.orderBy(F.desc("c_acctbal"), "c_custkey")).cast("long"))
    return k.where(F.col("k").isin(1, 10, 100)).select("k", F.col("c_acctbal").alias("value"))


@register("WITH e AS (SELECT quantile_cont(c_acctbal, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM customer) SELECT CAST(len(list_filter(q, lambda x: x < c_acctbal)) AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n FROM customer CROSS JOIN e GROUP BY 1")
def decile_bins(spark, d):
    c = table(spark, d, "customer")
    e = ranks.quantiles(c, [], "c_acctbal", [i / 10 for i in range(1, 10)]).select(F.array(*(F.col(f"q{i}") for i in range(1, 10))).alias("q"))
    return c.crossJoin(F.broadcast(e)).groupBy(F.size(F.filter("q", lambda x: x < F.col("c_acctbal"))).alias("bin")).agg(F.count("*").alias("n"))


@register("SELECT name, row_number() OVER (PARTITION BY name ORDER BY k) - 1 AS copy FROM (SELECT p_type AS name, p_partkey AS k FROM part)")
def make_unique(spark, d):
    """Numbers by which equal names are told apart."""
    p = table(spark, d, "part").select(F.col("p_type").alias("name"), F.col("p_partkey").alias("k"))
    return ranks.numbered(p, ["name"], ["k"], "copy").select("name", "copy")


@register(SM + " SELECT round(sum(abs(a.value - b.value)), 4) AS l1, round(sum(pow(a.value - b.value, 2)), 4) AS l2 FROM cells a JOIN cells b ON a.col_id = b.col_id AND b.row_id = a.row_id + 1")
def pointwise_losses(spark, d):
    """L1 and L2 between neighbouring suppliers' rows."""
    c = supplier_month(spark, d).cells
    b = c.select((F.col("row_id") - 1).alias("row_id"), "col_id", F.col("value").alias("w"))
    x = F.col("value") - F.col("w")
    return rounded(c.join(b, ["row_id", "col_id"]).agg(F.sum(F.abs(x)).alias("l1"), F.sum(x * x).alias("l2")), "l1", "l2", digits=4)


_LATER = ", later AS (SELECT user_id AS row_id, event_type AS col_id, CAST(count(*) AS DOUBLE) AS value FROM events WHERE event_id % 50 <> 7 GROUP BY 1, 2)"


@register(UE + _LATER + " SELECT count(*) FILTER (WHERE a.value IS DISTINCT FROM b.value) AS n_different, count(*) FILTER (WHERE a.value IS DISTINCT FROM b.value) = 0 AS equal FROM cells a FULL JOIN later b ON a.row_id = b.row_id AND a.col_id = b.col_id")
def matrices_equal(spark, d):
    """A full outer join counts the cells in which two matrices differ: all events, and those without some."""
    a = user_event(spark, d).cells
    some = table(spark, d, "events").where("event_id % 50 <> 7")
    b = CountMatrix.from_table(some, F.col("user_id"), F.col("event_type")).cells.withColumnRenamed("value", "w")
    n = F.count(F.when(~F.col("value").eqNullSafe(F.col("w")), 1))
    return a.join(b, ["row_id", "col_id"], "full").agg(n.alias("n_different"), (n == 0).alias("equal"))


@register("SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def zero_padded_vector(spark, d):
    """A vector over the customers that have orders, extended by zeros to all."""
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "customer").select("c_custkey").join(n, "c_custkey", "left").na.fill(0, ["n"])


@register(SM + DENSE + ", h AS (SELECT col_id, avg(value) AS mean, var_samp(value) AS variance FROM dense GROUP BY 1) SELECT col_id, round(ln(mean), 5) AS log_mean, round(ln(variance), 5) AS log_variance FROM h")
def mean_variance_log(spark, d):
    from countloom.operators.marginals import moments

    h = moments(supplier_month(spark, d), 0)
    return rounded(h.select("col_id", F.log("mean").alias("log_mean"), F.log("variance").alias("log_variance")), "log_mean", "log_variance", digits=5)


@register()
def knn_classifier(spark, d):
    """Cross-validated neighbour votes on all vectors, by seeded folds."""
    p = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("values"), "label")
    return rounded(X.classifier(p, [2, 5, 10, 20, 40, 80, 160]), "accuracy")


@register()
def stability_of_rank(spark, d):
    return rounded(X.stability(supplier_month(spark, d), repeats=2), "sigma", "ks", digits=4)


@register()
def depth_correlation(spark, d):
    return rounded(X.depth_correlation(supplier_month(spark, d), 3), "r", digits=5)


@register()
def low_rank_mean_variance(spark, d):
    return rounded(X.low_rank_moments(supplier_month(spark, d), 3), "mean", "variance", digits=5)


@register()
def top_features_of_components(spark, d):
    from countloom.operators.spectrum import svd

    return X.top_features(svd(supplier_month(spark, d), 3), spark, 10)


@register()
def silhouette_by_components(spark, d):
    m = supplier_month(spark, d)
    labels = table(spark, d, "supplier").select(F.col("s_suppkey").alias("row_id"), (F.col("s_nationkey") % 4).alias("label"))
    return rounded(X.silhouette_by_components(m, labels, [2, 4]), "silhouette", digits=5)


@register()
def low_rank_threshold_chosen(spark, d):
    """The rank is told by a noise run."""
    return rounded(X.low_rank_threshold(supplier_month(spark, d)), "value", digits=5)


@register()
def parameter_table(spark, d):
    """Fits of two matrices of the same suppliers."""
    found = X.parameter_table({"brand": supplier_brand(spark, d), "month": supplier_month(spark, d)})
    return rounded(found, "sigma", "ks", "bhat", "chat", "b", "c", digits=5)


@register()
def low_rank_threshold(spark, d):
    return rounded(X.low_rank_threshold(supplier_month(spark, d), 2), "value", digits=5)
