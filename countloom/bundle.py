"""Count matrices as tables: cells (row_id, col_id, value), obs (row_id, ...), var (col_id, ...).

Cells hold what is stored: absent is an observed zero, NaN is missing. Rows and columns are those of obs and var, with or
without cells. Ids are the natural keys, so no global numbering is needed.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from countloom.session import cut


@dataclass(frozen=True)
class CountMatrix:
    cells: DataFrame
    obs: DataFrame
    var: DataFrame
    uns: dict = field(default_factory=dict)
    #: obs and var are those that occur in cells
    occurring: bool = False

    @classmethod
    def from_table(cls, df: DataFrame, row: Column, col: Column, measure: Column | None = None) -> CountMatrix:
        """Counts (or sums of ``measure``) by row and column key; rows and columns are those that occur."""
        keyed = df.select(row.alias("row_id"), col.alias("col_id"), (F.lit(1.0) if measure is None else measure.cast("double")).alias("m"))
        cells = keyed.groupBy("row_id", "col_id").agg(F.sum("m").alias("value"))
        return cls(cells, cells.select("row_id").distinct(), cells.select("col_id").distinct(), occurring=True)

    @classmethod
    def from_rows(cls, df: DataFrame, row: Column, values: str) -> CountMatrix:
        """A table with one array per row."""
        cells = df.select(row.alias("row_id"), F.posexplode(values).alias("col_id", "v")).select("row_id", F.col("col_id").cast("long").alias("col_id"), F.col("v").cast("double").alias("value"))
        return cls(cells, cells.select("row_id").distinct(), cells.select("col_id").distinct(), occurring=True)

    @property
    def shape(self) -> tuple[int, int]:
        return self.obs.count(), self.var.count()

    def transpose(self) -> CountMatrix:
        cells = self.cells.select(F.col("col_id").alias("row_id"), F.col("row_id").alias("col_id"), "value")
        return CountMatrix(cells, self.var.withColumnRenamed("col_id", "row_id"), self.obs.withColumnRenamed("row_id", "col_id"), self.uns, self.occurring)

    def with_cells(self, cells: DataFrame) -> CountMatrix:
        return replace(self, cells=cells, occurring=False)

    def settled(self) -> CountMatrix:
        """The same, stored in the shared folder: for what passes over it many times."""
        cells = cut(self.cells, "cells")
        if self.occurring:
            return replace(self, cells=cells, obs=cut(cells.select("row_id").distinct(), "obs"), var=cut(cells.select("col_id").distinct(), "var"))
        return replace(self, cells=cells, obs=cut(self.obs, "obs"), var=cut(self.var, "var"))

    def map_values(self, value: Column) -> CountMatrix:
        return self.with_cells(self.cells.select("row_id", "col_id", value.alias("value")))

    def submatrix(self, rows: DataFrame | None = None, cols: DataFrame | None = None) -> CountMatrix:
        """The rows and columns listed (tables with row_id and col_id)."""
        cells, obs, var = self.cells, self.obs, self.var
        if rows is not None:
            cells, obs = cells.join(rows.select("row_id"), "row_id", "left_semi"), obs.join(rows.select("row_id"), "row_id", "left_semi")
        if cols is not None:
            cells, var = cells.join(cols.select("col_id"), "col_id", "left_semi"), var.join(cols.select("col_id"), "col_id", "left_semi")
        return CountMatrix(cells, obs, var, self.uns)

    def densify(self) -> DataFrame:
        """All M x N cells, zeros included. The size is that of the result; for order statistics over small axes."""
        grid = self.obs.select("row_id").crossJoin(F.broadcast(self.var.select("col_id"))) if self.var.count() <= 100_000 else self.obs.select("row_id").crossJoin(self.var.select("col_id"))
        return grid.join(self.cells, ["row_id", "col_id"], "left").select("row_id", "col_id", F.coalesce("value", F.lit(0.0)).alias("value"))

    def fill_missing(self) -> CountMatrix:
        """NaN becomes zero, and zeros are not stored."""
        return self.with_cells(self.cells.withColumn("value", F.nanvl("value", F.lit(0.0))).where("value <> 0"))

    def write(self, path: str, mode: str = "errorifexists") -> None:
        for name in ("cells", "obs", "var"):
            getattr(self, name).write.mode(mode).parquet(f"{path}/{name}")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> CountMatrix:
        return cls(*(spark.read.parquet(f"{path}/{n}") for n in ("cells", "obs", "var")))


def subsample(ids: DataFrame, col: str, n: int, seed: int) -> DataFrame:
    """``n`` ids of smallest seeded hash: the same ones on every run."""
    return ids.orderBy(F.xxhash64(F.lit(seed), col), col).limit(n)
