"""Registry of the queries over count tables: name -> builder, and name -> SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from countloom.bundle import CountMatrix

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None, name: str | None = None):
    """Adds a builder under its name, with its SQL."""

    def add(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql:
            SQL[key] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison (adding zero turns -0.0 into 0.0)."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in cols})


# --- the matrices that the queries run on, and the same as SQL


def supplier_month(spark: SparkSession, d: str) -> CountMatrix:
    """Orders lines by supplier and month of shipping."""
    return CountMatrix.from_table(table(spark, d, "lineitem"), F.col("l_suppkey"), F.date_format("l_shipdate", "yyyy-MM"))


def user_event(spark: SparkSession, d: str) -> CountMatrix:
    return CountMatrix.from_table(table(spark, d, "events"), F.col("user_id"), F.col("event_type"))


def user_hour(spark: SparkSession, d: str) -> CountMatrix:
    return CountMatrix.from_table(table(spark, d, "events"), F.col("user_id"), F.hour("ts").cast("long"))


def customer_month(spark: SparkSession, d: str) -> CountMatrix:
    return CountMatrix.from_table(table(spark, d, "orders"), F.col("o_custkey"), F.date_format("o_orderdate", "yyyy-MM"))


def supplier_brand(spark: SparkSession, d: str) -> CountMatrix:
    joined = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return CountMatrix.from_table(joined, F.col("l_suppkey"), F.col("p_brand"))


def _count(row: str, col: str, source: str) -> str:
    return f"cells AS (SELECT {row} AS row_id, {col} AS col_id, CAST(count(*) AS DOUBLE) AS value FROM {source} GROUP BY 1, 2)"


AXES = ", obs AS (SELECT DISTINCT row_id FROM cells), var AS (SELECT DISTINCT col_id FROM cells), dims AS (SELECT (SELECT CAST(count(*) AS DOUBLE) FROM obs) AS m, (SELECT CAST(count(*) AS DOUBLE) FROM var) AS n)"
SM = "WITH " + _count("l_suppkey", "strftime(l_shipdate, '%Y-%m')", "lineitem") + AXES
UE = "WITH " + _count("user_id", "event_type", "events") + AXES
UH = "WITH " + _count("user_id", "CAST(hour(ts) AS BIGINT)", "events") + AXES
CM = "WITH " + _count("o_custkey", "strftime(o_orderdate, '%Y-%m')", "orders") + AXES
SB = "WITH " + _count("l_suppkey", "p_brand", "lineitem JOIN part ON l_partkey = p_partkey") + AXES
DENSE = ", dense AS (SELECT o.row_id, v.col_id, coalesce(c.value, 0.0) AS value FROM obs o CROSS JOIN var v LEFT JOIN cells c ON c.row_id = o.row_id AND c.col_id = v.col_id)"

from countloom.plans import algebra as _algebra, cells as _cells, evaluation as _evaluation, experiments as _experiments, models as _models, pipelines as _pipelines  # noqa: E402, F401
