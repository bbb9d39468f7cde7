"""Modalities: which annotations a kind of count table gets, and its default filters.

A modality inherits its parent's limits; its own override them (see ``filters.merged``).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from countloom.bundle import CountMatrix
from countloom.operators import filters


@dataclass(frozen=True)
class Modality:
    name: str
    total: str  # name of the rows' sums
    detected: str  # name of the rows' non-zero counts
    var_total: str
    var_detected: str
    parent: Modality | None = None
    obs_limits: dict = field(default_factory=dict)
    var_limits: dict = field(default_factory=dict)
    subset: str | None = None  # rows also get this part's total and share
    counts_cells: bool = False  # totals count the non-zeros, they do not add them

    def limits(self) -> tuple[dict, dict]:
        base = self.parent.limits() if self.parent else ({}, {})
        return filters.merged(base[0], self.obs_limits), filters.merged(base[1], self.var_limits)

    def annotate(self, m: CountMatrix, flag: Column | None = None) -> tuple[DataFrame, DataFrame]:
        """(obs, var) with the modality's columns; existing columns of the same names are updated."""
        found = F.count(F.when(F.col("value") != 0, 1))
        total = found if self.counts_cells else F.sum("value")
        aggs = [total.alias(self.total), found.alias(self.detected)]
        if self.subset:
            part = F.sum(F.when(flag if flag is not None else F.lit(False), F.col("value")).otherwise(0.0))
            aggs += [part.alias(f"total_{self.subset}"), F.coalesce(F.try_divide(part, F.sum("value")), F.lit(0.0)).alias(f"pct_{self.subset}")]
        o = m.cells.groupBy("row_id").agg(*aggs)
        v = m.cells.groupBy("col_id").agg(total.alias(self.var_total), found.alias(self.var_detected))
        return _updated(m.obs, o, "row_id"), _updated(m.var, v, "col_id")

    def filter(self, m: CountMatrix, flag: Column | None = None, n_iters: int = 2) -> CountMatrix:
        obs, var = self.limits()
        return filters.iterative_filter(m, lambda x: self.annotate(x, flag), obs, var, n_iters)


def annotate_paired(m: CountMatrix, assay: Column, flag: Column) -> tuple[DataFrame, DataFrame]:
    """(obs, var) of two assays in one table: ``assay`` says of a column whether it is a site (true) or a gene, ``flag`` which genes are apart.

    Rows get totals and detections of either assay and the share of the flagged genes (0 without genes); columns get theirs.
    """
    x = m.cells.join(m.var.select("col_id", assay.alias("_site"), (flag & ~assay).alias("_flag")), "col_id")
    found = F.col("value") != 0
    part = lambda c: F.sum(F.when(c, F.col("value")).otherwise(0.0))
    o = x.groupBy("row_id").agg(
        F.count(F.when(F.col("_site") & found, 1)).alias("total_sites"), part(F.col("_site")).alias("total_peaks"),
        F.count(F.when(~F.col("_site") & found, 1)).alias("total_genes"), part(~F.col("_site")).alias("total_UMIs"), part(F.col("_flag")).alias("total_MT_UMIs"),
    )
    o = o.withColumn("pct_MT_UMIs", F.coalesce(F.try_divide("total_MT_UMIs", "total_UMIs"), F.lit(0.0)))
    v = x.groupBy("col_id").agg(F.count(F.when(found, 1)).alias("total_cells"), F.sum("value").alias("total_counts"))
    return _updated(m.obs, o, "row_id"), _updated(m.var, v, "col_id")


def annotate_reads(obs: DataFrame, reads: DataFrame, flag: Column) -> DataFrame:
    """``obs`` (row_id, total_reads, ...) with mapped reads and shares from a second layer of cells; ``flag`` is on its col_id.

    Rows without reads have none mapped; a share of nothing is 0.
    """
    x = reads.groupBy("row_id").agg(F.sum("value").alias("mapped_reads"), F.sum(F.when(flag, F.col("value")).otherwise(0.0)).alias("MT_reads"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return _updated(obs, x, "row_id").withColumns({"pct_mapped_reads": share("mapped_reads", "total_reads"), "pct_MT_reads": share("MT_reads", "mapped_reads")})


def _updated(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    made = [c for c in new.columns if c != key]
    return table.drop(*made).join(new, key, "left").na.fill(0, made)


SIMULATION = Modality("simulation", "total", "total_nz", "total", "total_nz", obs_limits={"total_nz": {"min": 10}}, var_limits={"total_nz": {"min": 10}})
CONTACTS = Modality("contacts", "total_contacts", "detected_contacts", "total_contacts", "detected_contacts", counts_cells=True)
ACCESSIBILITY = Modality("accessibility", "total_peaks", "total_sites", "total_peaks", "total_cells")
MULTIOME_ACCESSIBILITY = Modality("multiome accessibility", "total_peaks", "total_sites", "total_peaks", "total_cells", ACCESSIBILITY, {"total_sites": {"min": 100}}, {"total_cells": {"min": 50}})
EXPRESSION = Modality("expression", "total_UMIs", "total_genes", "total_UMIs", "total_cells", subset="MT_UMIs")
PAIRED_EXPRESSION = Modality("paired expression", "total_UMIs", "total_genes", "total_UMIs", "total_cells", EXPRESSION, {"total_genes": {"min": 100}}, {"total_cells": {"min": 100}}, "MT_UMIs")
DROPLET_EXPRESSION = Modality("droplet expression", "total_UMIs", "total_genes", "total_UMIs", "total_cells", EXPRESSION, {"total_genes": {"min": 100}, "pct_MT_UMIs": {"max": 0.1}}, {"total_cells": {"min": 100}}, "MT_UMIs")
GENOTYPES = Modality("genotypes", "total_counts", "total_SNPs", "total_counts", "total_obs")
IMAGING = Modality("imaging", "total", "total_pixels", "total", "total_frames", obs_limits={"total_pixels": {"min": 1}}, var_limits={"total_frames": {"min": 1}})
SPATIAL = Modality("spatial", "total_counts", "total_genes", "total_counts", "total_obs", obs_limits={"total_genes": {"min": 20}}, var_limits={"total_obs": {"min": 100}})
READ_EXPRESSION = Modality("read expression", "total_UMIs", "total_genes", "total_UMIs", "total_cells", EXPRESSION, subset="MT_UMIs")
PAIRED_ASSAYS = Modality("paired assays", "total_counts", "total_features", "total_counts", "total_cells")
METHYLATION = Modality("methylation", "total", "total_bins", "total", "total_obs")
MODALITIES = {m.name: m for m in (SIMULATION, CONTACTS, ACCESSIBILITY, MULTIOME_ACCESSIBILITY, EXPRESSION, PAIRED_EXPRESSION, DROPLET_EXPRESSION, GENOTYPES, IMAGING, SPATIAL, READ_EXPRESSION, PAIRED_ASSAYS, METHYLATION)}


@dataclass(frozen=True)
class Dataset:
    """A table of several samples of one modality, with limits and fit options of its own."""

    name: str
    modality: Modality
    obs_limits: dict = field(default_factory=dict)
    var_limits: dict = field(default_factory=dict)
    fit_options: dict = field(default_factory=dict)
    hidden: tuple[str, ...] = ()

    def limits(self) -> tuple[dict, dict]:
        base = self.modality.limits()
        return filters.merged(base[0], self.obs_limits), filters.merged(base[1], self.var_limits)

    def samples(self, cells: DataFrame, col: str = "sample") -> list[str]:
        """The visible samples (a few names)."""
        return sorted(r[0] for r in cells.select(col).distinct().collect() if r[0] not in self.hidden)

    def filter(self, samples: dict[str, CountMatrix], *, intersect: bool = True, n_iters: int = 2) -> dict[str, CountMatrix]:
        """Each sample filtered by itself; with ``intersect`` only columns that all keep."""
        obs, var = self.limits()
        kept = {k: filters.iterative_filter(m, self.modality.annotate, obs, var, n_iters) for k, m in samples.items()}
        if intersect and len(kept) > 1:
            common = None
            for m in kept.values():
                common = m.var.select("col_id") if common is None else common.join(m.var, "col_id", "left_semi")
            kept = {k: m.submatrix(cols=common) for k, m in kept.items()}
        return kept
