"""Queries on representation, marginals, filters and set operations."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from countloom.bundle import CountMatrix, subsample
from countloom.operators import filters, marginals, ranks, sampling
from countloom.plans.catalog import AXES, CM, DENSE, SB, SM, UE, UH, customer_month, register, rounded, supplier_brand, supplier_month, table, user_event, user_hour


@register(SM + " SELECT row_id, col_id, value FROM cells")
def count_matrix_supplier_month(spark, d):
    return supplier_month(spark, d).cells


@register(CM + " SELECT row_id, sum(value) AS total FROM cells GROUP BY 1")
def marginals_rows(spark, d):
    return marginals.sums(customer_month(spark, d), 1)


@register(CM + " SELECT col_id, sum(value) AS total FROM cells GROUP BY 1")
def marginals_cols(spark, d):
    return marginals.sums(customer_month(spark, d), 0)


@register(CM + " SELECT quantile_cont(total, 0.5) AS median_total FROM (SELECT sum(value) AS total FROM cells GROUP BY row_id)")
def library_size_median(spark, d):
    return marginals.library_size_median(customer_month(spark, d))


@register(CM + " SELECT row_id, CAST(count(*) AS BIGINT) AS nnz FROM cells WHERE value <> 0 GROUP BY 1")
def nnz_along(spark, d):
    return marginals.nnz(customer_month(spark, d), 1)


@register(CM + " SELECT col_id, round(sum(value) / any_value(m), 6) AS mean FROM cells, dims GROUP BY 1")
def column_means(spark, d):
    return rounded(marginals.means(customer_month(spark, d), 0), "mean")


@register(CM + " SELECT row_id, round(avg(value), 6) AS mean FROM cells WHERE value <> 0 GROUP BY 1")
def row_means_nonzero(spark, d):
    return rounded(marginals.means(customer_month(spark, d), 1, consider_zeros=False), "mean")


@register(CM + DENSE + " SELECT col_id, round(avg(value), 6) AS mean, round(var_samp(value), 6) AS variance FROM dense GROUP BY 1")
def mean_variance(spark, d):
    return rounded(marginals.moments(customer_month(spark, d), 0), "mean", "variance")


@register(CM + DENSE + " SELECT row_id, min(value) AS low, max(value) AS high FROM dense GROUP BY 1")
def min_max_axis(spark, d):
    return marginals.extremes(customer_month(spark, d), 1)


@register(UH + DENSE + ", r AS (SELECT row_id, min(value) AS a, max(value) AS b FROM dense GROUP BY 1) SELECT row_id, col_id, round((value - a) / (b - a), 6) AS value FROM dense JOIN r USING (row_id) WHERE b > a")
def feature_scale(spark, d):
    """Min-max scaling of each row; constant rows have no scale."""
    m = user_hour(spark, d)
    x = m.densify().join(marginals.extremes(m, 1), "row_id").where("high > low")
    return rounded(x.select("row_id", "col_id", ((F.col("value") - F.col("low")) / (F.col("high") - F.col("low"))).alias("value")), "value")


@register(UE + " SELECT row_id, sum(value) AS total, CAST(count(*) AS BIGINT) AS detected, sum(CASE WHEN lower(col_id) LIKE '%err%' THEN value ELSE 0.0 END) AS subset_total, round(sum(CASE WHEN lower(col_id) LIKE '%err%' THEN value ELSE 0.0 END) / sum(value), 6) AS subset_share FROM cells GROUP BY 1")
def qc_annotations_user_event(spark, d):
    return rounded(marginals.qc(user_event(spark, d), F.lower("col_id").contains("err")), "subset_share")


_QC = ", qc AS (SELECT row_id, sum(value) AS total, CAST(count(*) AS BIGINT) AS detected FROM cells GROUP BY 1)"


@register(CM + _QC + " SELECT row_id, total, detected FROM qc WHERE total >= 8 AND detected <= 12")
def range_filter(spark, d):
    return filters.range_filter(_qc(customer_month(spark, d)), {"total": {"min": 8}, "detected": {"max": 12}})


@register(CM + _QC + " SELECT row_id, total, detected FROM qc WHERE NOT (row_id % 2 = 0) OR total >= 10")
def masked_range_filter(spark, d):
    q = _qc(customer_month(spark, d)).withColumn("even", F.col("row_id") % 2 == 0)
    return filters.range_filter(q, {"total": {"min": 10}}, "even").drop("even")


def _qc(m: CountMatrix):
    return m.cells.groupBy("row_id").agg(F.sum("value").alias("total"), F.count("*").alias("detected"))


def _annotate(m: CountMatrix):
    return marginals.nnz(m, 1), marginals.nnz(m, 0)


def _passes(n: int, rows: int, cols: int) -> str:
    out, src = "", "cells"
    for i in range(n):
        out += f", r{i} AS (SELECT row_id FROM {src} WHERE value <> 0 GROUP BY 1 HAVING count(*) >= {rows}), c{i} AS (SELECT col_id FROM {src} WHERE value <> 0 GROUP BY 1 HAVING count(*) >= {cols}), k{i} AS (SELECT * FROM {src} WHERE row_id IN (SELECT row_id FROM r{i}) AND col_id IN (SELECT col_id FROM c{i}))"
        src = f"k{i}"
    return out


@register(CM + _passes(2, 7, 5) + " SELECT row_id, col_id, value FROM k1")
def iterative_filter_2pass(spark, d):
    m = customer_month(spark, d)
    return filters.iterative_filter(m, _annotate, {"nnz": {"min": 7}}, {"nnz": {"min": 5}}).cells


@register(CM + _passes(1, 9, 30) + " SELECT row_id, col_id, value FROM k0")
def stabilize_simultaneous(spark, d):
    return filters.stabilize(customer_month(spark, d), 9, 30).cells


@register(CM + ", r AS (SELECT row_id FROM cells GROUP BY 1 HAVING count(*) >= 9), k AS (SELECT * FROM cells WHERE row_id IN (SELECT row_id FROM r)), c AS (SELECT col_id FROM k GROUP BY 1 HAVING count(*) >= 20) SELECT row_id, col_id, value FROM k WHERE col_id IN (SELECT col_id FROM c)")
def stabilize_rows_first(spark, d):
    return filters.stabilize(customer_month(spark, d), 9, 20, order="rows_first").cells


@register(CM + ", c AS (SELECT col_id FROM cells GROUP BY 1 HAVING count(*) >= 30), k AS (SELECT * FROM cells WHERE col_id IN (SELECT col_id FROM c)), r AS (SELECT row_id FROM k GROUP BY 1 HAVING count(*) >= 9) SELECT row_id, col_id, value FROM k WHERE row_id IN (SELECT row_id FROM r)")
def stabilize_cols_first(spark, d):
    return filters.stabilize(customer_month(spark, d), 9, 30, order="cols_first").cells


@register("WITH x AS (SELECT DISTINCT s_nationkey % 5 AS sample, p_brand AS col_id FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 49) SELECT col_id FROM x GROUP BY 1 HAVING count(DISTINCT sample) = (SELECT count(DISTINCT sample) FROM x)")
def common_features_across_samples(spark, d):
    x = table(spark, d, "lineitem").where("l_quantity >= 49").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return filters.common_columns(x.select((F.col("s_nationkey") % 5).alias("sample"), F.col("p_brand").alias("col_id")), "sample")


@register(SB + DENSE + " SELECT row_id, col_id, value FROM dense")
def densify(spark, d):
    return supplier_brand(spark, d).densify()


@register(SM + " SELECT col_id AS row_id, row_id AS col_id, value FROM cells")
def transpose(spark, d):
    return supplier_month(spark, d).transpose().cells


@register(CM + " SELECT row_id, col_id, value FROM cells WHERE row_id % 7 = 0 AND col_id >= '1996-01'")
def submatrix(spark, d):
    m = customer_month(spark, d)
    return m.submatrix(m.obs.where("row_id % 7 = 0"), m.var.where("col_id >= '1996-01'")).cells


@register(UH + " SELECT row_id, col_id, value FROM cells WHERE NOT ((row_id + col_id) % 11 = 0)")
def fill_missing(spark, d):
    m = user_hour(spark, d)
    lost = (F.col("row_id") + F.col("col_id")) % 11 == 0
    return m.map_values(F.when(lost, F.lit(float("nan"))).otherwise(F.col("value"))).fill_missing().cells


@register(UH + ", lost AS (SELECT * FROM cells WHERE (row_id + col_id) % 11 = 0), r AS (SELECT row_id, count(*) AS k FROM lost GROUP BY 1), c AS (SELECT col_id, count(*) AS k FROM lost GROUP BY 1), g AS (SELECT 1 - (SELECT count(*) FROM lost) / (m * n) AS share FROM dims) SELECT x.row_id, x.col_id, round(least((1 - coalesce(r.k, 0) / n) * (1 - coalesce(c.k, 0) / m) / share, 1.0), 6) AS p FROM cells x CROSS JOIN dims CROSS JOIN g LEFT JOIN r ON r.row_id = x.row_id LEFT JOIN c ON c.col_id = x.col_id")
def sampling_probability(spark, d):
    m = user_hour(spark, d)
    lost = (F.col("row_id") + F.col("col_id")) % 11 == 0
    return rounded(marginals.sampling_probability(m.map_values(F.when(lost, F.lit(float("nan"))).otherwise(F.col("value")))), "p")


@register(UE + " SELECT a.row_id, a.col_id, a.value * b.value AS value FROM cells a JOIN cells b ON a.row_id = b.row_id AND a.col_id = b.col_id")
def hadamard(spark, d):
    m = user_event(spark, d)
    return m.cells.join(m.cells.withColumnRenamed("value", "w"), ["row_id", "col_id"]).select("row_id", "col_id", (F.col("value") * F.col("w")).alias("value"))


@register(UE + ", h AS (" + UH.removeprefix("WITH cells AS (").split(")" + AXES)[0] + ") SELECT a.col_id AS i, b.col_id AS k, sum(a.value * b.value) AS value FROM cells a JOIN h b ON a.row_id = b.row_id GROUP BY 1, 2")
def matmul(spark, d):
    """Event types by hours: the product of two matrices over users."""
    a = user_event(spark, d).cells.select("row_id", F.col("col_id").alias("i"), F.col("value").alias("x"))
    b = user_hour(spark, d).cells.select("row_id", F.col("col_id").alias("k"), F.col("value").alias("y"))
    return a.join(b, "row_id").groupBy("i", "k").agg(F.sum(F.col("x") * F.col("y")).alias("value"))


@register(UE + " SELECT (SELECT bool_and(value >= 0) FROM cells) AS non_negative, (SELECT bool_or(value > 50) FROM cells) AS any_large, (SELECT max(value) FROM cells) AS high")
def boolean_reductions(spark, d):
    return user_event(spark, d).cells.agg(F.bool_and(F.col("value") >= 0).alias("non_negative"), F.bool_or(F.col("value") > 50).alias("any_large"), F.max("value").alias("high"))


@register(UH + DENSE + " SELECT col_id, quantile_cont(value, 0.9) AS q90, quantile_cont(value, 0.5) AS q50 FROM dense GROUP BY 1")
def axis_quantiles(spark, d):
    return ranks.quantiles(user_hour(spark, d).densify(), ["col_id"], "value", [0.9, 0.5], ["q90", "q50"])


@register(UE + " SELECT row_id, col_id, CAST(row_number() OVER (PARTITION BY row_id ORDER BY value DESC, col_id) AS BIGINT) AS place FROM cells")
def argsort_rows(spark, d):
    w = Window.partitionBy("row_id").orderBy(F.desc("value"), "col_id")
    return user_event(spark, d).cells.select("row_id", "col_id", F.row_number().over(w).cast("long").alias("place"))


@register(SM + " SELECT row_id, col_id, value FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY value DESC, col_id) AS k FROM cells) WHERE k <= 10")
def top_k_features(spark, d):
    w = Window.partitionBy("row_id").orderBy(F.desc("value"), "col_id")
    return supplier_month(spark, d).cells.withColumn("k", F.row_number().over(w)).where("k <= 10").drop("k")


@register("WITH e AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) SELECT o_custkey, CAST(coalesce(sum(n) FILTER (o_orderpriority = '1-URGENT'), 0) AS BIGINT) AS urgent, CAST(coalesce(sum(n) FILTER (o_orderpriority = '5-LOW'), 0) AS BIGINT) AS low FROM e GROUP BY 1")
def pivot_scores(spark, d):
    p = table(spark, d, "orders").groupBy("o_custkey").pivot("o_orderpriority", ["1-URGENT", "5-LOW"]).count()
    return p.select("o_custkey", F.coalesce("1-URGENT", F.lit(0)).alias("urgent"), F.coalesce("5-LOW", F.lit(0)).alias("low"))


@register("SELECT s_suppkey, name, value FROM (SELECT s_suppkey, CAST(s_nationkey AS DOUBLE) AS nation, s_acctbal AS balance FROM supplier) UNPIVOT (value FOR name IN (nation, balance))")
def unpivot_scores(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("nation"), F.col("s_acctbal").alias("balance"))
    return s.unpivot("s_suppkey", ["nation", "balance"], "name", "value")


@register("SELECT c_mktsegment, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS BIGINT) AS code FROM (SELECT DISTINCT c_mktsegment FROM customer)")
def label_encoding(spark, d):
    seg = table(spark, d, "customer").select("c_mktsegment").distinct()
    return ranks.numbered(seg, [], ["c_mktsegment"], "code")


@register("SELECT n_name AS name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier) INTERSECT SELECT n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 0)")
def set_intersect(spark, d):
    n = table(spark, d, "nation")
    a = n.join(table(spark, d, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left_semi").select(F.col("n_name").alias("name"))
    b = n.join(table(spark, d, "customer").where("c_acctbal > 0"), F.col("n_nationkey") == F.col("c_nationkey"), "left_semi").select(F.col("n_name").alias("name"))
    return a.intersect(b)


@register("SELECT p_partkey FROM part WHERE p_size > 25 EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def set_except(spark, d):
    left = table(spark, d, "part").where("p_size > 25").select("p_partkey")
    return left.join(table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti").distinct()


@register("SELECT c_custkey, coalesce(total, 0.0) AS total FROM customer LEFT JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def update_join(spark, d):
    """Annotations updated where the other table has a value."""
    t = table(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return table(spark, d, "customer").join(t, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("total", F.lit(0.0)).alias("total"))


@register("SELECT a.r_name AS left_name, b.r_name AS right_name FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey")
def combinations(spark, d):
    r = table(spark, d, "region")
    return r.select(F.col("r_regionkey").alias("i"), F.col("r_name").alias("left_name")).join(r.select(F.col("r_regionkey").alias("j"), F.col("r_name").alias("right_name")), F.col("i") < F.col("j")).select("left_name", "right_name")


@register("SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def value_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@register("SELECT s_nationkey, CASE s_nationkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'mid' ELSE 'other' END AS label, CAST(count(*) AS BIGINT) AS n FROM supplier GROUP BY 1, 2")
def relabel_categories(spark, d):
    names = F.create_map(F.lit(0), F.lit("low"), F.lit(1), F.lit("mid"))
    return table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n")).select("s_nationkey", F.coalesce(F.try_element_at(names, F.col("s_nationkey") % 3), F.lit("other")).alias("label"), "n")


@register("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_fields(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@register("WITH x AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) SELECT p_brand, p_partkey FROM x WHERE k <= 5")
def stratified_quota(spark, d):
    """At most five of each group, by a stated order."""
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return table(spark, d, "part").withColumn("k", F.row_number().over(w)).where("k <= 5").select("p_brand", "p_partkey")


@register()
def quota_with_top_up(spark, d):
    """Forty parts of each brand, as evenly over types as they allow."""
    return sampling.with_top_up(table(spark, d, "part").select("p_brand", "p_type", "p_partkey"), "p_brand", "p_type", 40, "p_partkey")


@register()
def seeded_subsample(spark, d):
    """The same rows on every run: those of smallest seeded hash."""
    m = customer_month(spark, d)
    rows = subsample(m.obs.select("row_id"), "row_id", max(1, m.obs.count() // 4), 42)
    return m.submatrix(rows=rows).cells


@register()
def auto_stabilize(spark, d):
    m = filters.auto_stabilize(user_hour(spark, d))
    return m.cells
