"""Two-pass external shuffle into shards.

Pass 1 scatters the records by seeded hashes: the shard by rendezvous hashing of the id (so the id and the
number of shards decide, and one more shard takes rows only into itself), the bucket inside the shard by a hash
of id and text, with as many buckets as keep each near ``bucket_bytes``. Buckets are counted; one of more than twice
``bucket_bytes`` (rows that repeat an id and a text, or many null ids) is split, by a hash of all columns and, as equal
rows are the same to it, by a running number of the stored rows. Pass 2 takes one bucket, a task of its own, into memory,
puts it in a canonical order, applies a Fisher-Yates shuffle seeded by (seed, bucket), gives out ``slot`` (the bucket's
rows follow those of the shard's buckets before it) and writes it as Parquet: the files of a shard follow by name,
and the rows of a file by ``slot``. A bucket's content and order depend on its rows and the seed alone, so a lost task
that is run again writes the same. The driver holds 16 bytes a bucket.

Null texts count as empty, null ids share one shard. Repeated rows are all kept. An empty table gives no rows.
Other columns are written along; columns named like the operator's own (``size``, ``text_crc32``, ``shard``,
``grown_shard``, ``bucket``, ``slot``) are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from countloom.session import cut

OWN = ("size", "text_crc32", "shard", "grown_shard", "bucket", "slot")
ROW_BYTES = 16


def rendezvous(key: Column, n: int, seed: int) -> Column:
    """The shard among ``n`` whose seeded hash with the key is largest."""
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(F.xxhash64(F.lit(seed), i, key).alias("h"), i.alias("i"))))
    return best["i"].cast("int")


def scatter(docs: DataFrame, n_shards: int, *, seed: int = 0, bucket_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, np.ndarray]:
    """Pass 1: rows with size, crc, shard and bucket (numbered through all shards); and how many rows each bucket has."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.drop(*OWN)
    sized = base.withColumn("size", F.octet_length(text).cast("long") + ROW_BYTES)
    total = sized.agg(F.sum("size")).first()[0] or 0
    per_shard = max(1, -(-total // (n_shards * bucket_bytes)))
    key = F.col(id_col)
    out = sized.withColumns(
        {
            "text_crc32": F.crc32(F.encode(text, "UTF-8")),
            "shard": rendezvous(key, n_shards, seed),
            "grown_shard": rendezvous(key, n_shards + 1, seed),
        }
    )
    within = F.pmod(F.xxhash64(F.lit(seed + 1), key, F.col("text_crc32"), F.col("size")), F.lit(per_shard)).cast("int")
    out = out.withColumn("bucket", F.col("shard") * F.lit(per_shard) + within)
    n = n_shards * per_shard
    rows, held = _counted(out, n)
    pieces = np.maximum(1, -(-held // bucket_bytes)) * (held > 2 * bucket_bytes) + (held <= 2 * bucket_bytes)
    if pieces.max() == 1:
        return out, rows
    out = cut(out, "scattered")  # a running number is the same again only over stored rows
    number = F.pmod(F.xxhash64(F.lit(seed + 2), *(c for c, t in base.dtypes if not t.startswith("map"))), F.lit(1 << 20)) + F.monotonically_increasing_id()
    first = F.lit((np.cumsum(pieces) - pieces).tolist())
    split = F.pmod(number, F.element_at(F.lit(pieces.tolist()), F.col("bucket") + 1))
    out = cut(out.withColumn("bucket", (F.element_at(first, F.col("bucket") + 1) + split).cast("int")), "scattered")
    return out, _counted(out, int(pieces.sum()))[0]


def _counted(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and bytes of each of ``n`` buckets."""
    found = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("size")).toArrow()
    out = np.zeros((2, n), np.int64)
    out[:, found.column("bucket").to_numpy()] = found.column("n").to_numpy(), found.column("size").to_numpy()
    return out[0], out[1]


def _shuffled(table: pa.Table, seed: int, id_col: str, before: np.ndarray) -> pa.Table:
    """One bucket: canonical order, then Fisher-Yates."""
    ids = table.column(id_col).fill_null(0).to_numpy() if pa.types.is_integer(table.schema.field(id_col).type) else np.array([str(x) for x in table.column(id_col).to_pylist()])
    keys = [table.column("size").to_numpy(), table.column("text_crc32").to_numpy(), ids]
    order = np.lexsort(keys)
    same = np.logical_and.reduce([k[order][1:] == k[order][:-1] for k in keys])
    if same.any():  # what is equal so far goes by all its columns, so that the order does not depend on arrival
        tied = np.zeros(len(order), bool)
        tied[order[1:][same]] = tied[order[:-1][same]] = True
        more = np.full(len(order), "", object)
        more[tied] = [repr(list(r.values())) for r in table.filter(pa.array(tied)).to_pylist()]
        order = np.lexsort([more.astype(str), *keys])
    bucket = table.column("bucket")[0].as_py()
    rng = np.random.Generator(np.random.PCG64([seed, bucket]))
    rng.shuffle(order)  # in place, from the last slot down
    return table.take(pa.array(order)).append_column(pa.field("slot", pa.int64()), pa.array(np.arange(len(order)) + before[bucket]))


def shuffle_buckets(scattered: DataFrame, rows: np.ndarray, n_shards: int, *, seed: int = 0, id_col: str = "doc_id") -> DataFrame:
    """Pass 2: each bucket in its shuffled order, with ``slot``, its gapless place in the shard; a partition holds one bucket."""
    schema = T.StructType([*scattered.schema.fields, T.StructField("slot", T.LongType())])
    shard_of = scattered.select("bucket", "shard").distinct().toArrow()
    shards = np.zeros(len(rows), np.int64)
    shards[shard_of.column("bucket").to_numpy()] = shard_of.column("shard").to_numpy()
    total = np.concatenate(([0], np.cumsum(rows)))[:-1]
    start = np.zeros(n_shards, np.int64)
    at, first = np.unique(shards[rows > 0], return_index=True)
    start[at] = total[rows > 0][first]
    before = total - start[shards]  # rows in the shard's buckets before it
    held = scattered.sparkSession.sparkContext.broadcast(before)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if whole := [b for b in batches if b.num_rows]:
            yield from _shuffled(pa.Table.from_batches(whole), seed, id_col, held.value).to_batches(2000)

    return scattered.repartitionById(len(rows), F.col("bucket")).mapInArrow(run, schema)


def write_shards(docs: DataFrame, path: str, n_shards: int, *, seed: int = 0, bucket_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``docs`` below ``path`` as rows/shard=0 ... n_shards-1; files in the order of their names hold slots 0, 1, ..."""
    scattered, rows = scatter(docs, n_shards, seed=seed, bucket_bytes=bucket_bytes, id_col=id_col, text_col=text_col)
    shuffled = shuffle_buckets(scattered, rows, n_shards, seed=seed, id_col=id_col)
    shuffled.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(f"{path}/rows")  # the writer's own sort would not keep slots
    shuffled.limit(0).write.parquet(f"{path}/schema")


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The written rows; ``slot`` is their place in the shard."""
    return spark.read.schema(spark.read.parquet(f"{path}/schema").schema).parquet(f"{path}/rows")
