"""Suffix-array dedup: bytes covered by a string of ``length`` bytes that also starts anywhere else are removed.

The index is a logarithmic family of suffix arrays. Texts reach it as anchored contexts (see ``anchors``), so that equal
strings meet in one *bucket*, that of their anchor. A bucket takes its contexts in batches: each batch gets a suffix
array (its window starts in the order of their first ``length`` bytes), which is merge-scanned against every level that
the bucket holds; neighbours of the merged order that agree over the whole length are matches, and both sides are marked.
The array becomes a level itself, and levels of like size merge, so that n starts lie in O(log n) levels and each is merged
O(log n) times. Bytes are compared, not hashes; equal contexts are compared as wholes and enter an array once.

``dedup`` runs a family over one table: Bloom filters of bounded size keep the contexts away whose anchor stands once, and
the windows of a hot anchor are dealt by 128 bits of their hash, which decide there. ``Index`` keeps the family on disk
as tables: ``add`` merge-scans a new batch of texts against the levels stored by earlier ones.

Strings are judged on the input; overlaps with themselves and repeats inside one text count. Null texts are empty. Rows
that repeat are texts of their own (and so repeat each other). Matches never cross texts. Ids may be null or of any type;
they only tell rows apart. Other columns pass through (but for ``removed``, which is replaced). An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from countloom.llm.anchors import COUNTS, RANGES, SHIPMENT_BYTES, SHIPPED, Filters, Shipment, anchors, batch_counts, chosen, context_hash, covered, decided, packed, ranges_of, united
from countloom.llm.common import byte_column, private
from countloom.session import cut

GRAM = 80
#: Contexts of a bucket that get a suffix array together.
BATCH_CONTEXTS = 32
_TABLE = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64)
_LOW = (1 << 32) - 1


def _symbols(data: bytes) -> np.ndarray:
    return _TABLE[np.frombuffer(data, np.uint8)]


class Family:
    """Levels of suffix arrays over the windows of ``texts``; ``marked`` tells which window starts have a match.

    An array lists places (text << 32 | start) in the order of the ``length`` bytes that start there.
    """

    def __init__(self, length: int):
        self.length = length
        self.texts: list[bytes] = []
        self.marked: list[bytearray] = []
        self.levels: list[list[int]] = []

    def windows(self, array: list[int]) -> list[bytes]:
        texts, n = self.texts, self.length
        return [texts[at >> 32][at & _LOW : (at & _LOW) + n] for at in array]

    def take(self, texts: list[bytes]) -> int:
        base = len(self.texts)
        self.texts += texts
        self.marked += [bytearray(len(t) - self.length + 1) for t in texts]
        return base

    def restore(self, texts: list[bytes], array: np.ndarray) -> None:
        """A level that was stored."""
        base = self.take(texts)
        self.levels.append((array + (base << 32)).tolist())

    def add(self, texts: list[bytes], *, merge: bool = True) -> list[int]:
        """A new batch: its suffix array, scanned against itself and every level; then levels of like size ``merge``."""
        base = self.take(texts)
        places = [(base + i) << 32 | s for i, t in enumerate(texts) for s in range(len(t) - self.length + 1)]
        new = self._sorted(places)
        for level in self.levels:
            self._sorted(level + new)
        self.levels.append(new)
        while merge and len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            last, before = self.levels.pop(), self.levels.pop()
            self.levels.append(self._sorted(before + last))
        return new

    def _sorted(self, places: list[int]) -> list[int]:
        """Places in suffix order (two sorted runs are merged by one scan); equal neighbours are marked."""
        windows = self.windows(places)
        order = sorted(range(len(places)), key=windows.__getitem__)
        out = [places[i] for i in order]
        before = None
        for i, at in zip(order, out):
            if windows[i] == before:
                self.marked[at >> 32][at & _LOW] = self.marked[last >> 32][last & _LOW] = 1
            before, last = windows[i], at
        return out


def _texts(batch: pa.RecordBatch, length: int) -> Iterator[tuple[int, bytes]]:
    for owner, text in zip(batch.column(0).to_pylist(), byte_column(batch, batch.schema.names[1])):
        if text and len(text) >= length:
            yield owner, text


def _chosen_keys(texts: DataFrame, length: int, k: int) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for _, text in _texts(batch, length):
                view = memoryview(text)
                for key, place, first, end in anchors(_symbols(text), length, k):
                    rows.append((key, [context_hash(view[a : b + length - 1], p - a) for a, b, p in zip(first.tolist(), end.tolist(), place.tolist())], 0))
                    size += len(key)
                if size > 400_000:
                    yield batch_counts(rows)
                    rows, size = [], 0
            yield batch_counts(rows)

    return cut(chosen(texts.mapInArrow(count, COUNTS), "n > 1"), "keys")


def _contexts(text: bytes, length: int, k: int, may) -> Iterator[tuple[int, int, bytes, int, int]]:
    """(key, ctx, data, window starts, first start) of the contexts whose key ``may`` repeat (None: of all)."""
    for key, place, first, end in anchors(_symbols(text), length, k):
        on = np.arange(len(key)) if may is None else np.flatnonzero(may(key))
        for x, p, a, b in zip(key[on].tolist(), place[on].tolist(), first[on].tolist(), end[on].tolist()):
            data = text[a : b + length - 1]
            yield x, context_hash(data, p - a), data, b - a, a


def removals(keyed: DataFrame, *, length: int, k: int, text_col: str) -> DataFrame:
    """(_key, _pieces): for each text the ranges that its repeated windows cover."""
    texts = keyed.select("_key", text_col)
    filters = Filters(_chosen_keys(texts, length, k), length - k + 1)

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shipment = Shipment(filters.parts, length, False, _symbols, filters.may_be_hot)
        for batch in batches:
            for owner, text in _texts(batch, length):
                for key, ctx, data, n, first in _contexts(text, length, k, filters.may):
                    shipment.add(key, ctx, data, n, 0, owner, first)
                if shipment.held > SHIPMENT_BYTES:
                    yield shipment.batch()
        yield shipment.batch()

    def bucket(rows: Iterator[tuple[int, bytes, bytes]]) -> Iterator[tuple[bytes, np.ndarray]]:
        """The contexts of one key, equal ones together: (how often, data, owners)."""
        found: list[bytes] = []
        owners: list[bytes | None] = []  # of contexts that have stood once so far
        for n, data, own in rows:
            if again := bool(found) and found[-1] == data:
                if owners[-1]:
                    yield owners[-1], np.arange(len(data) - length + 1)
                owners[-1] = None
            else:
                found.append(data)
                owners.append(own if n == 1 else None)
            if again and own:
                yield own, np.arange(len(data) - length + 1)
        if len(found) > 1:
            family = Family(length)
            for a in range(0, len(found), BATCH_CONTEXTS):
                family.add(found[a : a + BATCH_CONTEXTS])
            for own, marked in zip(owners, family.marked):
                if own:
                    yield own, np.flatnonzero(np.frombuffer(marked, np.uint8))

    shipped = texts.mapInArrow(ship, SHIPPED).repartitionById(filters.parts, F.col("part")).sortWithinPartitions("key", "ctx")
    return united(shipped.mapInArrow(lambda batches: decided(batches, length, False, bucket), RANGES))


def _applied(base: DataFrame, joined: DataFrame, length: int, text_col: str) -> DataFrame:
    """``base``'s columns of ``joined`` with ``removed``, from ``_pieces``."""
    schema = T.StructType([*base.schema.fields, T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])
    names = base.columns
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(x) if x else 0 for x in byte_column(batch, text_col)]
            pieces = batch.column(batch.schema.get_field_index("_pieces"))
            spans = [[{"start": a, "end": b} for a, b in found] for found in covered(pieces, sizes)]
            yield pa.RecordBatch.from_pydict({c: batch.column(batch.schema.get_field_index(c)) for c in names} | {"removed": pa.array(spans, spans_type)})

    return joined.mapInArrow(apply, schema)


@private("_key", "_pieces")
def dedup(docs: DataFrame, *, length: int = 200, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM) -> DataFrame:
    """``docs`` with ``removed``: sorted, disjoint byte ranges (start, end) to take out of the UTF-8 text."""
    base = docs.drop("removed")
    keyed = base.withColumn("_key", F.xxhash64(id_col, text_col))
    return _applied(base, keyed.join(removals(keyed, length=length, k=gram, text_col=text_col), "_key", "left"), length, text_col)


INDEX_ROWS = "kind string, part int, level int, key long, ids binary, data binary, array binary"
_INDEX = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("level", pa.int32()), ("key", pa.int64()), ("ids", pa.binary()), ("data", pa.binary()), ("array", pa.binary())])


def _level(family: Family, owners: list[bytes], places: list[int], level: int, key: int, parts: int) -> pa.RecordBatch:
    """The bucket's part of a new level: texts, and the one array that sorted runs of places merge into."""
    texts = sorted({at >> 32 for at in places})
    number = {t: i for i, t in enumerate(texts)}
    array = np.array([number[at >> 32] << 32 | at & _LOW for at in family._sorted(places)], np.int64)
    lens = np.array([len(family.texts[t]) for t in texts], np.int64)
    row = {"kind": "level", "part": key % parts, "level": level, "key": key, "ids": b"".join(owners[t] for t in texts), "data": b"".join(family.texts[t] for t in texts), "array": lens.tobytes() + array.tobytes()}
    return pa.RecordBatch.from_pylist([row], schema=_INDEX)


class Index:
    """The family on disk, below ``path`` in the shared folder: one table a level, and a table of manifests.

    ``add`` takes a batch of texts (id, text), merge-scans it against all levels and returns (id, ranges): byte ranges that
    are covered by repeated strings, of the new texts and of those added before. All contexts are stored, as any of them
    may repeat later (about five times the text). The contexts of one anchor stay in one bucket.
    """

    def __init__(self, spark: SparkSession, path: str, *, length: int = 200, gram: int = GRAM, parts: int = 64, version: int = 0):
        self.spark, self.path, self.length, self.gram, self.parts, self.version = spark, path, length, gram, parts, version

    def levels(self) -> list[tuple[int, int]]:
        """(level, contexts) of the live levels, oldest first: those of the manifest of this version."""
        if not self.version:
            return []
        return [tuple(r) for r in self.spark.read.parquet(f"{self.path}/manifest-{self.version}").orderBy("level").collect()]

    def add(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        length, gram, parts, schema = self.length, self.gram, self.parts, _INDEX
        live, new = self.levels(), self.version + 1

        def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for owner, text in _texts(batch, length):
                    rows = [("new", key % parts, new, key, np.array([owner, first], np.int64).tobytes(), data, None) for key, _, data, _, first in _contexts(text, length, gram, None)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        batch = cut(docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), text_col).mapInArrow(ship, INDEX_ROWS), "batch")
        n = batch.count()
        stays, merged = list(live), n
        while stays and stays[-1][1] < 2 * merged:
            merged += stays.pop()[1]
        goes = {x[0] for x in live} - {x[0] for x in stays}

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows() -> Iterator[dict]:
                for b in batches:
                    yield from b.to_pylist()

            for key, group in groupby(rows(), lambda r: r["key"]):
                family, owners, numbers, fresh = Family(length), [], [], []
                for r in group:  # stored levels first
                    if r["kind"] == "new":
                        fresh.append((r["data"], r["ids"]))
                        continue
                    k = len(r["ids"]) // 16
                    ends = np.cumsum(np.frombuffer(r["array"][: 8 * k], np.int64)).tolist()
                    family.restore([r["data"][a:b] for a, b in zip([0, *ends], ends)], np.frombuffer(r["array"][8 * k :], np.int64))
                    owners += [r["ids"][16 * i : 16 * i + 16] for i in range(k)]
                    numbers.append(r["level"])
                runs = [level for no, level in zip(numbers, family.levels) if no in goes]
                if fresh:
                    runs.append(family.add([d for d, _ in sorted(fresh)], merge=False))
                    owners += [o for _, o in sorted(fresh)]
                for own, marked in zip(owners, family.marked) if fresh else ():
                    starts = np.flatnonzero(np.frombuffer(marked, np.uint8))
                    if len(starts):
                        owner, first = np.frombuffer(own, np.int64).tolist()
                        yield pa.RecordBatch.from_pylist([{"kind": "range", "key": owner, "data": packed(ranges_of(starts, length) + first)}], schema=schema)
                if runs:
                    yield _level(family, owners, [x for run in runs for x in run], new, key, parts)

        rows = batch
        for level, _ in live:
            rows = rows.unionByName(self.spark.read.schema(INDEX_ROWS).parquet(f"{self.path}/level-{level}").where("kind = 'level'"))
        rows.repartitionById(parts, F.col("part")).sortWithinPartitions("key", "level").mapInArrow(scan, INDEX_ROWS).write.mode("overwrite").parquet(f"{self.path}/level-{new}")
        self.spark.createDataFrame([*stays, (new, merged)], "level int, contexts long").write.mode("overwrite").parquet(f"{self.path}/manifest-{new}")
        self.version = new
        found = self.spark.read.schema(INDEX_ROWS).parquet(f"{self.path}/level-{new}").where("kind = 'range'")
        return found.groupBy(F.col("key").alias(id_col)).agg(F.collect_set("data").alias("ranges"))


def kept_bytes(df: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``df`` with ``kept`` (binary): the bytes outside ``removed``."""
    data = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    size = F.octet_length(text_col)
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("removed", lambda s: s["end"]))
    ends = F.concat(F.transform("removed", lambda s: s["start"]), F.array(F.coalesce(size, F.lit(0)).cast("long")))
    slices = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda x: F.substring(F.col("_data"), (x["a"] + 1).cast("int"), (x["b"] - x["a"]).cast("int")))
    joined = F.aggregate(slices, F.lit(b""), lambda a, x: F.concat(a, x))
    return df.withColumn("_data", data).withColumn("kept", F.when(F.size("removed") == 0, F.col("_data")).otherwise(joined)).drop("_data")
