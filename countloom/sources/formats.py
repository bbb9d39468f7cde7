"""Sources and sinks: delimited text with damaged headers, MatrixMarket, matrix bundles, append-only results, a path catalog."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from countloom.bundle import CountMatrix
from countloom.operators import ranks
from countloom.session import cut


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def header_of(line: str, delimiter: str) -> list[str]:
    """Column names of a header line: quotes and byte order mark stripped, missing names become column{i}, repeats get a suffix."""
    names, seen = [], {}
    for i, raw in enumerate(line.lstrip("﻿").rstrip("\r\n").split(delimiter)):
        name = raw.strip().strip("\"'") or f"column{i}"
        n = seen[name] = seen.get(name, -1) + 1
        names.append(f"{name}-{n}" if n else name)
    return names


def read_delimited(spark: SparkSession, path: str, delimiter: str = ",", *, index: str | None = None) -> DataFrame:
    """A delimited file whose header may lack names; the values' types are inferred.

    Rows one field longer than the header have an unnamed first column (row names).
    """
    lines = spark.read.text(path).limit(2).collect()
    if not lines:
        return spark.createDataFrame([], T.StructType([]))
    names = header_of(lines[0][0], delimiter)
    if len(lines) > 1 and len(lines[1][0].split(delimiter)) == len(names) + 1:
        names = ["column0", *names]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = spark.read.schema(schema).option("sep", delimiter).option("header", True).option("enforceSchema", True).csv(path)
    probe = spark.read.option("sep", delimiter).option("header", True).option("inferSchema", True).csv(path)
    kinds = [f.dataType for f in probe.schema.fields]
    kinds = kinds if len(kinds) == len(names) else [T.StringType()] * len(names)
    out = raw.select(*(F.col(f"`{n}`").try_cast(k).alias(n) for n, k in zip(names, kinds)))
    return out.withColumnRenamed(names[0], index) if index else out


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(number, value): the lines of one text file with their places from 0.

    Places within a split of the file are known to its task; how many lines stand before it comes from a count a split.
    """
    files = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    found = files.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("id").alias("first")).orderBy("start").collect()
    if len({r["file"] for r in found}) > 1:
        raise ValueError("lines are numbered in one file at a time")
    before, rows = 0, []
    for r in found:
        rows.append((r["start"], before - r["first"]))
        before += r["n"]
    offsets = spark.createDataFrame(rows, "start long, offset long")
    return files.join(F.broadcast(offsets), "start").select((F.col("id") + F.col("offset")).alias("number"), "value")  # a row a split


def read_matrix_market(spark: SparkSession, path: str) -> CountMatrix:
    """Coordinate MatrixMarket (.mtx, .mtx.gz, or a folder that ``write_matrix_market`` made), 1-based in the file and 0-based here.

    Rows and columns are as many as the size line says, which is the first that is neither empty nor a comment. Raises if the file holds another number of cells than it says.
    """
    if _exists(spark, f"{path}/cells") and _exists(spark, f"{path}/header"):
        lines, head = spark.read.text(f"{path}/cells"), [r[0] for r in spark.read.text(f"{path}/header").collect()]  # two lines
        pattern, size = "pattern" in head[0].lower(), head[-1].split()
    else:
        numbered = numbered_lines(spark, path).where(F.trim("value") != "")
        said = numbered.where(~F.col("value").startswith("%")).agg(F.min(F.struct("number", "value")).alias("m")).first()["m"]
        banner = numbered.agg(F.min(F.struct("number", "value"))).first()[0]
        if said is None:
            raise ValueError("the file has no size line")
        pattern, size = "pattern" in banner["value"].lower() and banner["value"].startswith("%%"), said["value"].split()
        lines = numbered.where((F.col("number") > said["number"]) & ~F.col("value").startswith("%")).select("value")
    rows, cols, stored = map(int, size)
    p = F.split(F.trim("value"), r"\s+")
    value = F.lit(1.0) if pattern else p[2].cast("double")
    cells = lines.where(F.trim("value") != "").select((p[0].cast("long") - 1).alias("row_id"), (p[1].cast("long") - 1).alias("col_id"), value.alias("value"))
    if (held := cells.count()) != stored:
        raise ValueError(f"the size line says {stored} cells, the file holds {held}")
    return CountMatrix(cells, spark.range(rows).select(F.col("id").alias("row_id")), spark.range(cols).select(F.col("id").alias("col_id")))


def write_matrix_market(m: CountMatrix, path: str) -> None:
    """Cells with 1-based ids (ids must be numbers from 0) as text parts below ``path``/cells; banner and size line are in ``path``/header."""
    rows, cols = m.shape
    spark = m.cells.sparkSession
    n = m.cells.count()
    m.cells.select(F.format_string("%d %d %s", F.col("row_id") + 1, F.col("col_id") + 1, F.col("value").cast("string"))).write.text(f"{path}/cells")
    spark.createDataFrame([("%%MatrixMarket matrix coordinate real general",), (f"{rows} {cols} {n}",)], "line string").coalesce(1).write.text(f"{path}/header")


def _first(spark: SparkSession, folder: str, names: list[str]) -> str:
    for name in names:
        for end in ("", ".gz"):
            if _exists(spark, f"{folder}/{name}{end}"):
                return f"{folder}/{name}{end}"
    raise FileNotFoundError(f"{folder} holds none of {', '.join(names)}")


def read_10x(spark: SparkSession, folder: str, *, unique: bool = False) -> CountMatrix:
    """A folder of matrix.mtx, barcodes.tsv and features.tsv (or genes.tsv), each perhaps .gz: rows are barcodes, columns features.

    ``obs`` has the barcode as row_id; ``var`` the feature's id as col_id, its ``name`` and ``feature_type`` where they are there. Or a folder that ``write_10x`` made.
    With ``unique`` repeated names get a number from the second on.
    """
    if _exists(spark, f"{folder}/names"):
        place = lambda kind: spark.read.parquet(f"{folder}/names/{kind}")
        barcodes, features, m = place("barcodes"), place("features"), read_matrix_market(spark, f"{folder}/matrix")
    else:
        m = read_matrix_market(spark, _first(spark, folder, ["matrix.mtx"]))
        parts = F.split("value", "\t")
        barcodes = numbered_lines(spark, _first(spark, folder, ["barcodes.tsv"])).select("number", parts[0].alias("barcode"))
        some = lambda i: F.when(F.size(parts) > i, parts[i])
        features = numbered_lines(spark, _first(spark, folder, ["features.tsv", "genes.tsv"])).select("number", parts[0].alias("feature"), some(1).alias("name"), some(2).alias("feature_type"))
    if (barcodes.count(), features.count()) != (m.shape[1], m.shape[0]):
        raise ValueError("barcodes and features are not as many as the matrix has columns and rows")
    if unique:
        copy = ranks.numbered(features, ["name"], ["number"], "copy")
        features = copy.withColumn("name", F.when(F.col("copy") > 0, F.concat_ws("-", "name", "copy")).otherwise(F.col("name"))).drop("copy")
    cells = m.cells.join(features.select(F.col("number").alias("row_id"), F.col("feature").alias("f")), "row_id").join(barcodes.select(F.col("number").alias("col_id"), F.col("barcode").alias("b")), "col_id")
    return CountMatrix(cells.select(F.col("b").alias("row_id"), F.col("f").alias("col_id"), "value"), barcodes.select(F.col("barcode").alias("row_id")), features.select(F.col("feature").alias("col_id"), "name", "feature_type"))


def write_10x(m: CountMatrix, folder: str) -> None:
    """The matrix with the names of rows and columns, in their order, as ``read_10x`` reads it."""
    barcodes = cut(ranks.numbered(m.obs.select(F.col("row_id").cast("string").alias("barcode")), [], ["barcode"]), "barcodes")
    extra = [F.col(c).cast("string") if c in m.var.columns else F.lit(None).cast("string").alias(c) for c in ("name", "feature_type")]
    features = cut(ranks.numbered(m.var.select(F.col("col_id").cast("string").alias("feature"), *extra), [], ["feature"]), "features")
    cells = m.cells.select(F.col("row_id").cast("string").alias("barcode"), F.col("col_id").cast("string").alias("feature"), "value")
    at = cells.join(features.select("feature", F.col("number").alias("r")), "feature").join(barcodes.select("barcode", F.col("number").alias("c")), "barcode")
    spark = m.cells.sparkSession
    rows, cols = features.count(), barcodes.count()
    write_matrix_market(CountMatrix(at.select(F.col("r").alias("row_id"), F.col("c").alias("col_id"), "value"), spark.range(rows).select(F.col("id").alias("row_id")), spark.range(cols).select(F.col("id").alias("col_id"))), f"{folder}/matrix")
    barcodes.write.parquet(f"{folder}/names/barcodes")
    features.write.parquet(f"{folder}/names/features")


def zip_members(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """(archive, member, line): the text lines of zip members; archives are dealt over tasks, one in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                with zipfile.ZipFile(io.BytesIO(data.as_py())) as z:
                    for member in z.namelist():
                        if member.endswith(suffix) and not member.endswith("/"):
                            with z.open(member) as f:
                                lines = io.TextIOWrapper(f, "utf-8", "replace")
                                while part := [x.rstrip("\r\n") for _, x in zip(range(10_000), lines)]:
                                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array([member] * len(part)), pa.array(part)], names=["archive", "member", "line"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "archive string, member string, line string")


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame], *, overwrite: bool = False) -> DataFrame:
    """The table at ``path``, made and written first where it is not there."""
    if overwrite or not _exists(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def append_new(rows: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Append the rows whose keys the table at ``path`` does not hold yet; returns the table."""
    spark = rows.sparkSession
    fresh = rows.join(spark.read.parquet(path).select(*keys), keys, "left_anti") if _exists(spark, path) else rows
    fresh.write.mode("append").parquet(path)
    return spark.read.parquet(path)


@dataclass(frozen=True)
class Catalog:
    """Where a dataset's raw, unfiltered and filtered tables are."""

    base: str
    dataset: str

    def path(self, stage: str, sample: str | None = None) -> str:
        if stage not in ("raw", "unfiltered", "filtered"):
            raise ValueError("stage is raw, unfiltered or filtered")
        return f"{self.base.rstrip('/')}/{self.dataset}/{stage}" + (f"/sample={sample}" if sample else "")
