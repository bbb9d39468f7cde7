"""Seeded simulated matrices: rows are drawn by tasks, each from its own generator, so any partitioning gives the same."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession, functions as F

from countloom.bundle import CountMatrix


def low_rank_means(cols: int, rank: int, library: float, seed: int) -> np.ndarray:
    """Loadings (rank x cols) with rows that sum to the library size."""
    rng = np.random.default_rng(seed)
    return rng.dirichlet(np.full(cols, 0.5), rank) * library


def counts(spark: SparkSession, rows: int, cols: int, *, rank: int = 5, kind: str = "poisson", b: float = 1.0, c: float = 0.0, library: float = 1000.0, draws: int = 2, seed: int = 42) -> CountMatrix:
    """Poisson, negative binomial (variance b x + c x^2 over the mean) or binomial counts of low-rank means."""
    if kind not in ("poisson", "negative_binomial", "binomial", "multinomial"):
        raise ValueError(f"unknown kind {kind!r}")
    load = low_rank_means(cols, rank, library, seed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch["id"].tolist():
                rng = np.random.default_rng((seed, row))
                mean = rng.dirichlet(np.ones(rank)) @ load * rng.lognormal(0, 0.3)
                if kind == "poisson":
                    x = rng.poisson(mean)
                elif kind == "negative_binomial":
                    theta = 1 / c
                    x = b * rng.negative_binomial(theta, theta / (theta + mean))
                elif kind == "binomial":
                    x = rng.binomial(draws, np.clip(mean / mean.max(), 0, 1))
                else:
                    x = rng.multinomial(int(library), mean / mean.sum())
                at = np.flatnonzero(x)
                out.append(pd.DataFrame({"row_id": row, "col_id": at, "value": x[at].astype(float)}))
            if out:
                yield pd.concat(out)

    cells = spark.range(rows).mapInPandas(run, "row_id long, col_id long, value double")
    return CountMatrix(cells, spark.range(rows).select(F.col("id").alias("row_id")), spark.range(cols).select(F.col("id").alias("col_id")))
