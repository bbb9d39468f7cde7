"""MatrixMarket and 10x folders."""

import gzip

import pytest
from pyspark.sql import functions as F

from countloom.bundle import CountMatrix
from countloom.operators import filters, scaling
from countloom.sources import formats


def cells(m):
    return sorted(map(tuple, m.cells.select("row_id", "col_id", "value").collect()))


def test_a_cell_like_the_size_line_stays(spark, tmp_path):
    (tmp_path / "a.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n% 2 2 3\n\n2 2 3\n1 1 5\n2 2 3\n 1 2  7\n")
    m = formats.read_matrix_market(spark, f"file://{tmp_path}/a.mtx")
    assert cells(m) == [(0, 0, 5.0), (0, 1, 7.0), (1, 1, 3.0)] and m.shape == (2, 2)


def test_many_comments_splits_and_gzip(spark, tmp_path):
    body = "%%MatrixMarket matrix coordinate pattern general\n" + "% note\n" * 20_000 + "300 2 600\n" + "".join(f"{i} {j}\n" for i in range(1, 301) for j in (1, 2))
    (tmp_path / "b.mtx").write_text(body)
    with gzip.open(tmp_path / "c.mtx.gz", "wt") as f:
        f.write(body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        for name in ("b.mtx", "c.mtx.gz"):
            m = formats.read_matrix_market(spark, f"file://{tmp_path}/{name}")
            assert cells(m) == [(i, j, 1.0) for i in range(300) for j in (0, 1)]
        lines = formats.numbered_lines(spark, f"file://{tmp_path}/b.mtx")
        assert lines.rdd.getNumPartitions() > 3 and [r[1] for r in sorted(lines.collect())] == body.splitlines()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_wrong_files_raise(spark, tmp_path):
    for text in ("%%MatrixMarket matrix coordinate real general\n2 2 2\n1 1 1\n", "% nothing\n"):
        (tmp_path / "w.mtx").write_text(text)
        with pytest.raises(ValueError):
            formats.read_matrix_market(spark, f"file://{tmp_path}/w.mtx")


def test_round_trips(spark, tmp_path):
    rows = [("r2", "g1", 2.5), ("r1", "g10", 1.0), ("r10", "g1", 4.0)]
    m = CountMatrix(
        spark.createDataFrame(rows, "row_id string, col_id string, value double"), spark.createDataFrame([("r1",), ("r2",), ("r10",), ("empty",)], "row_id string"),
        spark.createDataFrame([("g1", "A"), ("g10", "A"), ("g2", None)], "col_id string, name string"),
    )
    formats.write_10x(m, f"file://{tmp_path}/x")
    back = formats.read_10x(spark, f"file://{tmp_path}/x", unique=True)
    assert cells(back) == sorted(rows) and sorted(r[0] for r in back.obs.collect()) == ["empty", "r1", "r10", "r2"]
    assert sorted(map(tuple, back.var.select("col_id", "name").collect())) == [("g1", "A"), ("g10", "A-1"), ("g2", None)]


def test_10x_folder(spark, tmp_path):
    (tmp_path / "matrix.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n3 2 3\n1 1 4\n3 1 1\n2 2 9\n")
    (tmp_path / "barcodes.tsv").write_text("AAA-1\nCCC-1\n")
    with gzip.open(tmp_path / "features.tsv.gz", "wt") as f:
        f.write("E1\tgeneA\tGene Expression\nE2\tgeneB\tGene Expression\nE3\tgeneA\tPeaks\n")
    m = formats.read_10x(spark, f"file://{tmp_path}")
    assert cells(m) == [("AAA-1", "E1", 4.0), ("AAA-1", "E3", 1.0), ("CCC-1", "E2", 9.0)]
    assert sorted(map(tuple, m.var.collect()))[2] == ("E3", "geneA", "Peaks")


def test_stop_by_ratio_on_long_axes(spark, monkeypatch):
    """The option holds on either path, and is looked at in each iteration."""
    m = CountMatrix(spark.range(60).select((F.col("id") % 6).alias("row_id"), (F.col("id") / 6).cast("long").alias("col_id"), (F.col("id") % 7 + 1.0).alias("value")), spark.range(6).select(F.col("id").alias("row_id")), spark.range(10).select(F.col("id").alias("col_id")))
    near = [scaling.fit(m, F.col("value"), tol=1e-5, stop=stop) for stop in ("sums", "ratio")]
    monkeypatch.setattr(scaling, "VECTOR_LIMIT", 5)
    for (u, v, info), stop in zip(near, ("sums", "ratio")):
        fu, fv, far = scaling.fit(m, F.col("value"), tol=1e-5, stop=stop)
        assert abs(far["iterations"] - info["iterations"]) <= 1 and far["error"] < 1e-5
        for a, b in ((u, fu), (v, fv)):
            b = dict(b.collect())
            assert all(x == pytest.approx(b[i], rel=1e-4) for i, x in a.collect())
    with pytest.raises(ValueError):
        scaling.fit(m, F.col("value"), stop="never")


def test_unmet_bounds_raise(spark, monkeypatch):
    m = CountMatrix(spark.createDataFrame([(i, j, 1.0) for i in range(8) for j in range(8) if (i + j) % 5 == 0 or i == 0], "row_id long, col_id long, value double"), spark.range(8).select(F.col("id").alias("row_id")), spark.range(8).select(F.col("id").alias("col_id")))
    assert not filters.bound_holds(m, 1, 3)
    with pytest.raises(RuntimeError, match="bound"):
        filters.auto_stabilize(m, step=1, most=0)
