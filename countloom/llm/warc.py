"""Deterministic sharded WARC writer and reader.

Records are dealt into ranges of page ids whose borders follow from an exact histogram of payload bytes (so the
same rows always give the same files): bins heavier than ``shard_bytes`` are refined until none is or a bin is a single
id, whose records are then dealt by ranges of their digests (an id that repeats, null ids). Each range is a task of its own,
sorted, and written as WARC/1.1 with one gzip member a record; a task holds one record at a time. The driver holds a number
for each bin, at most ``FINE_BINS`` for each full shard. Headers and digests are made anew; a file is closed once its compressed size reaches ``roll_bytes``.
Tasks write under temporary names; what a task reports becomes the manifest (Parquet), and only files of the
manifest get their final names, so a task that is lost or runs twice leaves no half file behind: renaming again
changes nothing. The archive is what the manifest lists.

Among records with equal payloads of at least ``min_revisit`` bytes the one with the smallest page id is the
response and the others are revisits of it; smaller payloads are all responses. Null payloads are empty; null ids
sort first and never are the smallest id; rows that repeat the smallest id are all responses. Urls may be null or
hold any characters (control characters are percent-encoded). An empty table gives an empty manifest.
Paths: anything that pyarrow's ``FileSystem.from_uri`` opens and all executors share.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from countloom.session import cut

DATE = "2000-01-01T00:00:00Z"
BINS, FINE_BINS = 4096, 64
MANIFEST = "shard int, seq int, temp string, name string, n_records long, n_bytes long, sha256 string"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def ranges(ids: DataFrame, shard_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Of (id, bytes): first ids of disjoint bins in order, each bin's first shard and number of shards, and the number of all.

    Light bins share shards in order; a single id of more than ``shard_bytes`` has several.
    """
    low, high = ids.agg(F.min("id"), F.max("id")).first()
    low, high = low or 0, high or 0
    width = -(-(high - low + 1) // BINS)
    open_, done = {(low, width * BINS): width}, {}  # a bin to refine: the width of its parts
    while open_:
        firsts = np.array(sorted(a for a, _ in open_), np.int64)
        parts = np.array([w for _, w in sorted((a, w) for (a, _), w in open_.items())], np.int64)
        ends = np.array([min(a + n - 1, high) for a, n in sorted(open_)], np.int64)  # inclusive

        @F.pandas_udf("long")
        def part_of(x: pd.Series) -> pd.Series:
            v = x.to_numpy(np.int64)
            i = np.clip(np.searchsorted(firsts, v, "right") - 1, 0, None)
            inside = (v >= firsts[i]) & (v <= ends[i])
            return pd.Series(np.where(inside, firsts[i] + (v - firsts[i]) // parts[i] * parts[i], np.iinfo(np.int64).min))

        found = dict(ids.groupBy(part_of("id").alias("bin")).agg(F.sum("bytes")).collect())
        found.pop(np.iinfo(np.int64).min, None)
        width_of = lambda a: int(parts[np.searchsorted(firsts, a, "right") - 1])
        open_ = {}
        for a, weight in found.items():
            if weight > shard_bytes and (w := width_of(a)) > 1:
                open_[a, w] = -(-w // FINE_BINS)
            else:
                done[a] = weight
    first, count, at, total = [], [], 0, 0
    for a in sorted(done):
        n = max(1, -(-done[a] // shard_bytes))
        if total and total + done[a] > shard_bytes:
            at, total = at + 1, 0
        first.append(at)
        count.append(n)
        at, total = (at + n, 0) if n > 1 else (at, total + done[a])
    return np.array(sorted(done) or [0], np.int64), np.array(first or [0]), np.array(count or [1]), at + 1


def plan(pages: DataFrame, *, id_col: str, url_col: str, html_col: str, min_revisit: int, shard_bytes: int) -> tuple[DataFrame, int]:
    """One row per record with its range, digest and length, and for revisits a mark with the response's id; and the number of ranges.

    Payloads are shuffled once, into their ranges; a mark has the keys of its record and sorts before it.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumns({"digest": F.sha2(F.encode("html", "UTF-8"), 256), "length": F.octet_length("html").cast("long")})
    firsts = rows.where(F.col("length") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    firsts = cut(firsts.where("copies > 1 AND first IS NOT NULL").select("digest", "first"), "firsts")  # cut, so that the join can split a digest
    low = pages.agg(F.min(F.col(id_col).cast("long"))).first()[0] or 0
    id_ = F.coalesce("page_id", F.lit(low))
    bins, first, count, n = ranges(rows.select(id_.alias("id"), (F.col("length") + 500).alias("bytes")), shard_bytes)

    @F.pandas_udf("int")
    def shard_of(x: pd.Series, digest: pd.Series) -> pd.Series:
        i = np.searchsorted(bins, x.to_numpy(np.int64), "right") - 1
        return pd.Series((first[i] + (digest.to_numpy(np.int64) * count[i] >> 32)).astype(np.int32))

    placed = rows.withColumn("shard", shard_of(id_, F.conv(F.substring("digest", 1, 8), 16, 10).cast("long")))
    again = placed.select("shard", "page_id", "digest").join(firsts, "digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).distinct()
    pages_ = placed.select("shard", "page_id", "url", F.encode("html", "UTF-8").alias("payload"), "digest", "length", F.lit(None).cast("long").alias("refers_to"), F.lit(False).alias("mark"))
    marks = again.select("shard", "page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", F.lit(0).cast("long").alias("length"), F.col("first").alias("refers_to"), F.lit(True).alias("mark"))
    return pages_.unionByName(marks), n


def _urn(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id}:{digest}'.encode()).digest()[:16])}>"


def _record(fields: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()), ("Content-Length", str(len(block)))]) + "\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(head.encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def _page_record(page_id, url, payload, digest, length, refers_to, level: int) -> bytes:
    safe = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")
    kind = "response" if refers_to is None else "revisit"
    fields = [("WARC-Type", kind), ("WARC-Record-ID", _urn(page_id, digest)), ("WARC-Date", DATE), ("WARC-Target-URI", safe), ("WARC-Page-ID", "" if page_id is None else str(page_id))]
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Payload-Length", str(length)), ("Content-Type", "application/http;msgtype=response")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(refers_to, digest)), ("WARC-Refers-To-Page-ID", str(refers_to))]
    return _record(fields, http + (payload or b""), level)


class _File:
    """A file under a temporary name."""

    def __init__(self, root: str, shard: int, seq: int, level: int):
        self.shard, self.seq, self.n, self.size, self.sha = shard, seq, 0, 0, hashlib.sha256()
        self.name, self.temp = f"part-{shard:06d}-{seq:05d}.warc.gz", f"_temporary-{uuid.uuid4().hex}.warc.gz"
        fs, base = pafs.FileSystem.from_uri(root)
        fs.create_dir(base, recursive=True)
        self.out = fs.open_output_stream(f"{base}/{self.temp}", compression=None)
        self.put(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _urn(None, self.name)), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n", level))

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)

    def close(self) -> dict:
        self.out.close()
        return {"shard": self.shard, "seq": self.seq, "temp": self.temp, "name": self.name, "n_records": self.n, "n_bytes": self.size, "sha256": self.sha.hexdigest()}


def write(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = 100, roll_bytes: int = 16 << 20, shard_bytes: int = 32 << 20, level: int = 5) -> DataFrame:
    """Write the archive below ``path`` (a URI) and return its committed manifest."""
    spark = pages.sparkSession
    root = f"{path}/files"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("temp", pa.string()), ("name", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64()), ("sha256", pa.string())])
        file, done, marked = None, [], None
        for batch in batches:
            for shard, page_id, url, payload, digest, length, refers_to, mark in zip(*(c.to_pylist() for c in batch.columns)):
                if mark:
                    marked = (page_id, digest, refers_to)
                    continue
                if marked and marked[:2] == (page_id, digest):
                    payload, refers_to = None, marked[2]
                record = (page_id, url, payload, digest, length, refers_to)
                if file and (file.shard != shard or file.size >= roll_bytes):
                    done.append(file.close())
                    file = _File(root, shard, file.seq + 1 if file.shard == shard else 0, level)
                file = file or _File(root, shard, 0, level)
                file.put(_page_record(*record, level))
                file.n += 1
        if file:
            done.append(file.close())
        yield pa.RecordBatch.from_pylist(done, schema=schema)

    rows, n = plan(pages, id_col=id_col, url_col=url_col, html_col=html_col, min_revisit=min_revisit, shard_bytes=shard_bytes)
    rows.repartitionById(n, F.col("shard")).sortWithinPartitions("shard", "page_id", "digest", F.desc("mark"), "url").mapInArrow(run, MANIFEST).write.parquet(f"{path}/manifest")
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for temp, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if fs.get_file_info(f"{base}/{temp}").type != pafs.FileType.NotFound:
                    fs.move(f"{base}/{temp}", f"{base}/{name}")
                elif fs.get_file_info(f"{base}/{name}").type == pafs.FileType.NotFound:
                    raise FileNotFoundError(name)
            yield batch

    manifest.select("temp", "name").mapInArrow(commit, "temp string, name string").count()
    return manifest


def _parse(data: bytes) -> Iterator[dict]:
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data)), 1 << 16)
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode().rstrip("\r\n").partition(": ")
            fields[k] = v
        block = stream.read(int(fields["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n" or "sha256:" + hashlib.sha256(block).hexdigest() != fields["WARC-Block-Digest"]:
            raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
        if (kind := fields["WARC-Type"]) == "warcinfo":
            continue
        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
        digest, length = fields["WARC-Payload-Digest"].partition(":")[2], int(fields["WARC-Payload-Length"])
        if payload is not None and (hashlib.sha256(payload).hexdigest(), len(payload)) != (digest, length):
            raise ValueError(f"payload digest differs in {fields['WARC-Record-ID']}")
        number = lambda k: int(fields[k]) if fields.get(k) else None
        yield {"page_id": number("WARC-Page-ID"), "url": fields["WARC-Target-URI"], "record_type": kind, "refers_to": number("WARC-Refers-To-Page-ID"), "payload_bytes": length, "payload_digest": digest, "payload": payload}


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archive at ``path``; block and payload digests are verified. Revisits have no payload."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
    if manifest.isEmpty():
        return spark.createDataFrame([], RECORDS)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(f"{path}/files")
    listed = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).join(manifest.select("name"), "name", "left_semi").select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows, held = [], 0
                for row in _parse(data.as_py()):
                    rows.append(row)
                    held += row["payload_bytes"]
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return listed.mapInArrow(run, RECORDS)
