"""Seeded samples with exact quotas: the same rows on every run, however the input is split."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from countloom.operators import ranks


def quota(df: DataFrame, strata: list[str], quotas: DataFrame, by: list[str], size: str, id_col: str, *, seed: int = 42) -> DataFrame:
    """Of each of ``strata`` as many rows as ``quotas`` (by, size) says, or all if there are fewer.

    Rows are taken by their seeded hash of ``id_col`` (then by id), whose places come from ranges, so no stratum is sorted by one task.
    """
    cols = df.columns
    placed = ranks.numbered(df.withColumn("hash_", F.xxhash64(F.lit(seed), id_col)), strata, ["hash_", id_col], "place_")
    return ranks._joined(placed, quotas.select(*by, F.col(size).alias("most_")), by).where("place_ < most_").select(*cols)


def with_top_up(df: DataFrame, group: str, stratum: str, total: int, id_col: str, *, seed: int = 42) -> DataFrame:
    """``total`` rows of each ``group`` (all, if it has fewer), as evenly over its strata as they allow; what small strata lack is made up by the others.

    The first pass takes of each stratum its even share, floor(total / strata); the second fills up to ``total`` by the seeded hash
    from the rows of the group that were left. ``pass`` (1 or 2) says which took the row.
    """
    cols = df.columns
    strata = df.groupBy(group).agg(F.count_distinct(F.coalesce(F.col(stratum).cast("string"), F.lit(""))).alias("strata_"))
    hashed = ranks._joined(df.withColumn("hash_", F.xxhash64(F.lit(seed), id_col)), strata, [group])
    placed = ranks.numbered(hashed, [group, stratum], ["hash_", id_col], "place_")
    first = placed.withColumn("late_", (F.col("place_") >= F.floor(F.lit(total) / F.col("strata_"))).cast("int"))
    filled = ranks.numbered(first, [group], ["late_", "hash_", id_col], "at_").where(F.col("at_") < total)
    return filled.select(*cols, (F.col("late_") + 1).alias("pass"))
