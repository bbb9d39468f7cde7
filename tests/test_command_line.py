"""The command line, option by option."""

import numpy as np
import pytest

from countloom.__main__ import main
from countloom.operators import fit
from countloom.sources import formats, simulate


@pytest.fixture(scope="module")
def m(spark):
    return simulate.counts(spark, 50, 20, rank=2, library=3000.0, seed=7).settled()


def run(spark, m, tmp_path, *options):
    m.write(f"file://{tmp_path}/in", "overwrite")
    main([f"file://{tmp_path}/in", f"file://{tmp_path}/out", *options])
    read = lambda name: spark.read.parquet(f"file://{tmp_path}/out/{name}")
    return read, {r["name"]: r["value"] for r in read("params").collect()}


def test_whole_run(spark, m, tmp_path):
    read, params = run(spark, m, tmp_path, "--qits", "8")
    want = fit.fit(m, qits=8)
    assert params["rank"] == want.rank and params["bhat"] == pytest.approx(want.parameters["bhat"], rel=1e-6)
    assert read("fits").count() == 9 and read("raw_spectrum").count() == 20 and read("spectrum").count() == 20
    assert read("left").count() == 50 and read("right").count() == 20 and read("left_components").count() == 50
    assert read("scaled").count() == m.cells.count() and read("denoised").count() > 0


def test_given_parameters(spark, m, tmp_path):
    read, params = run(spark, m, tmp_path, "--b", "1", "--c", "0", "--no-refit", "--no-spectrum", "--components", "3", "--shrinker", "hard")
    assert params["bhat"] == 1 and params["chat"] == 0 and read("spectrum").count() == 3
    with pytest.raises(Exception):
        read("fits").count()


def test_binomial_and_10x(spark, m, tmp_path):
    most = int(m.cells.agg({"value": "max"}).first()[0]) + 1
    formats.write_10x(m, f"file://{tmp_path}/x")
    main([f"file://{tmp_path}/x", f"file://{tmp_path}/y", "--variance-estimator", "binomial", "--read-counts", str(most), "--no-spectrum", "--tol", "1e-4"])
    params = {r["name"]: r["value"] for r in spark.read.parquet(f"file://{tmp_path}/y/params").collect()}
    assert np.isfinite(params["sigma_residual"])


@pytest.mark.parametrize("options", [["--bhat", "1"], ["--c", "0"], ["--read-counts", "3"], ["--variance-estimator", "binomial"]])
def test_wrong_options(options):
    with pytest.raises(SystemExit):
        main(["a", "b", *options])
