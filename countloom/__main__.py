"""Command line: fit a count matrix and write the result tables."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from countloom.bundle import CountMatrix
from countloom.functions.elementwise import from_raw
from countloom.operators import fit as fitting, spectrum
from countloom.sources import formats


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="countloom", description=main.__doc__ or __doc__)
    p.add_argument("input", help="a bundle folder (cells, obs, var), a MatrixMarket file, or a folder of matrix.mtx, barcodes.tsv and features.tsv")
    p.add_argument("output", help="a folder for the result tables")
    p.add_argument("--bhat", type=float, help="linear variance coefficient; with --chat, no variance fit")
    p.add_argument("--chat", type=float)
    p.add_argument("--b", type=float, help="the raw linear coefficient; with --c, no variance fit")
    p.add_argument("--c", type=float)
    p.add_argument("--variance-estimator", default="quadratic", choices=("quadratic", "binomial"))
    p.add_argument("--read-counts", type=int, help="reads a cell, for the binomial variance")
    p.add_argument("--components", type=int, default=0, help="how many components to keep; 0: those above the edge of a long axis, all of a short one")
    p.add_argument("--keep-aspect", action="store_true", help="submatrices in the proportion of the matrix, --subsample-size being the shorter side")
    p.add_argument("--no-refit", action="store_true", help="leave the residual noise out of parameters and scalers")
    p.add_argument("--no-spectrum", action="store_true", help="do not write the spectrum of the raw counts and the fits of submatrices")
    p.add_argument("--qits", type=int, default=51, help="Chebyshev intervals of the variance fit")
    p.add_argument("--n-subsamples", type=int, default=5)
    p.add_argument("--subsample-size", type=int, default=5000)
    p.add_argument("--n-iter", type=int, default=500)
    p.add_argument("--tol", type=float, default=1e-6)
    p.add_argument("--shrinker", default="frobenius", choices=("frobenius", "operator", "soft", "hard", "nuclear"))
    p.add_argument("--seed", type=int, default=42)
    a = p.parse_args(args)
    if (a.bhat is None) != (a.chat is None) or (a.b is None) != (a.c is None):
        p.error("give --bhat and --chat, or --b and --c, together")
    if (a.variance_estimator == "binomial") != (a.read_counts is not None):
        p.error("the binomial variance needs --read-counts, and only it")
    if a.b is not None:
        a.bhat, a.chat = from_raw(a.b, a.c)
    spark = SparkSession.builder.appName("countloom").getOrCreate()
    if a.input.endswith((".mtx", ".mtx.gz")):
        m = formats.read_matrix_market(spark, a.input)
    else:
        m = CountMatrix.read(spark, a.input) if formats._exists(spark, f"{a.input}/cells") else formats.read_10x(spark, a.input)
    m = m.settled()
    known = {"bhat": a.bhat, "chat": a.chat} if a.bhat is not None else None
    size = {"size": a.subsample_size, "keep_aspect": True} if a.keep_aspect else {"side": a.subsample_size}
    options = size | {"n_subsamples": a.n_subsamples, "qits": a.qits, "seed": a.seed}
    if not (known or a.read_counts or a.no_spectrum):
        fitting.quadratic_fits(m.fill_missing(), **options).write.parquet(f"{a.output}/fits")
    f = fitting.fit(m, known, k=a.components or None, tol=a.tol, n_iter=a.n_iter, refit=not a.no_refit, read_counts=a.read_counts, **options)
    small, large = sorted(m.shape)
    f.u.write.parquet(f"{a.output}/left")
    f.v.write.parquet(f"{a.output}/right")
    spark.createDataFrame([(i, float(s), float(s * s / (large * f.sigma**2))) for i, s in enumerate(f.factors.s)], "component int, s double, eigenvalue double").write.parquet(f"{a.output}/spectrum")
    if not a.no_spectrum:
        raw, sigma, _, _ = spectrum.spectrum_of(m.fill_missing())
        spark.createDataFrame([(i, float(s), float(s * s / (large * sigma**2))) for i, s in enumerate(raw.s)], "component int, s double, eigenvalue double").write.parquet(f"{a.output}/raw_spectrum")
    said = {k: v for k, v in f.parameters.items() if isinstance(v, (int, float))} | {"rank": f.rank, "ks": f.kst}
    spark.createDataFrame([(k, float(v)) for k, v in said.items()], "name string, value double").write.parquet(f"{a.output}/params")
    f.denoised(a.shrinker).write.parquet(f"{a.output}/denoised")
    f.y.cells.write.parquet(f"{a.output}/scaled")
    f.components("left", a.shrinker).write.parquet(f"{a.output}/left_components")
    f.components("right", a.shrinker).write.parquet(f"{a.output}/right_components")


if __name__ == "__main__":
    main()
