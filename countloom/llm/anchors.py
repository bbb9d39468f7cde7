"""Anchored contexts: how repeats of a fixed length are found without comparing or shuffling whole texts.

In each window of ``length`` symbols the k-gram of smallest hash is its anchor (the first of equals), so equal windows
have equal anchors at equal offsets, wherever they stand. Consecutive windows with one anchor share a *context*: the
symbols that they cover. A context is known by the hash of its k-gram (``key``) and of its content (``ctx``).

1. ``batch_counts``, ``chosen``: keys that occur once hold no repeat; the others are *chosen*, and those with more than
   ``HOT_CONTEXTS`` differing contexts are *hot* (a line that very many texts hold, each going on differently).
2. ``Shipment``: the contexts of chosen keys travel to the shard of their key, one for each batch of texts (copies inside
   a batch are compared symbol by symbol). Hot ones are dealt window by window, by 128 bits of the window's hash.
3. ``decided``: a shard hands the contexts of one key at a time to an operator's own index and gets the windows that
   repeat; what comes out are ranges of symbols for each text. ``covered`` unites the ranges of a text.

A context may be cut anywhere (very long texts are taken in slices): windows are compared, not contexts. Texts without a
window give nothing, so null and empty texts and empty tables need no care here; an owner is a 64-bit number of a text,
and rows that share one get the same ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from countloom.llm.common import MULT, mix, spans_of

_BITS = 23
_LOW = np.uint64((1 << _BITS) - 1)
#: Most window starts taken at once.
SLICE = 1 << 21
#: Keys with more differing contexts than this are dealt window by window.
HOT_CONTEXTS = 256
#: What a batch of shipped contexts, and the hot windows of a shard, may hold in memory.
SHIPMENT_BYTES, HOT_BYTES = 8 << 20, 64 << 20
#: Bits of a Bloom filter: 16 for a key, between these powers of two (at most 128 MB are broadcast).
LEAST_BITS, MOST_BITS = 20, 30


def run_hashes(symbols: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of ``n`` symbols (given as random 64-bit values), by doubling."""
    h, p = symbols, 1
    while 2 * p <= n:
        h = h[:-p] * (MULT + np.uint64(2 * p)) + h[p:]
        h ^= h >> np.uint64(29)
        p *= 2
    if p < n:
        h = h[: len(symbols) - n + 1] * (MULT + np.uint64(1)) + h[n - p :][: len(symbols) - n + 1]
    return mix(h.copy() if h is symbols else h)


def anchors(symbols: np.ndarray, length: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(hash of the k-gram, its place, first window start, end of window starts) of every context, by slices."""
    starts = len(symbols) - length + 1
    for at in range(0, max(starts, 0), SLICE):
        part = symbols[at : at + SLICE + length - 1]
        h = run_hashes(part, k)
        m = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        width, p = length - k + 1, 1
        while 2 * p <= width:
            m = np.minimum(m[:-p], m[p:])
            p *= 2
        n = len(h) - width + 1
        if p < width:
            m = np.minimum(m[:n], m[width - p :][:n])
        place = (m & _LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        end = np.concatenate((first[1:], [n]))
        yield h[place[first]].view(np.int64), place[first] + at, first + at, end + at


def context_hash(data, offset: int) -> int:
    return xxhash.xxh3_64_intdigest(data, seed=offset) - (1 << 63)


# --- which keys repeat

COUNTS = "key long, n long, s long, lo long, hi long, first long, last long"
_COUNTS = pa.schema([(c.split()[0], pa.int64()) for c in COUNTS.split(", ")])


def batch_counts(rows: list[tuple[np.ndarray, list[int], int]]) -> pa.RecordBatch:
    """Of (keys, ctx hashes, id) of some texts: a key's occurrences, differing contexts, their bounds, and the ids' bounds."""
    if not rows:
        return pa.RecordBatch.from_pylist([], schema=_COUNTS)
    key = np.concatenate([r[0] for r in rows])
    ctx = np.concatenate([np.array(r[1], np.int64) for r in rows])
    doc = np.repeat(np.array([r[2] for r in rows], np.int64), [len(r[0]) for r in rows])
    order = np.lexsort((ctx, key))
    key, ctx, doc = key[order], ctx[order], doc[order]
    other = np.concatenate(([True], key[1:] != key[:-1]))
    first = np.flatnonzero(other)
    end = np.concatenate((first[1:], [len(key)]))
    fresh = other.copy()
    fresh[1:] |= ctx[1:] != ctx[:-1]
    cols = (key[first], end - first, np.add.reduceat(fresh.astype(np.int64), first), ctx[first], ctx[end - 1], np.minimum.reduceat(doc, first), np.maximum.reduceat(doc, first))
    return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], schema=_COUNTS)


def chosen(counts: DataFrame, repeats: str) -> DataFrame:
    """(key, hot, s): the keys whose totals meet ``repeats`` (a condition on n, s, lo, hi, first, last)."""
    total = counts.groupBy("key").agg(*(f(c).alias(c) for f, c in zip((F.sum, F.sum, F.min, F.max, F.min, F.max), ("n", "s", "lo", "hi", "first", "last"))))
    return total.where(repeats).select("key", ((F.col("s") > HOT_CONTEXTS) & (F.col("lo") < F.col("hi"))).alias("hot"), "s")


class Filters:
    """Bloom filters of the chosen and of the hot keys, as broadcasts, and the number of shards."""

    def __init__(self, keys: DataFrame, width: int):
        spark = keys.sparkSession
        n, hot, windows = keys.agg(F.count("*"), F.count_if("hot"), F.sum(F.when(F.col("hot"), F.col("s") * width))).first()
        size = lambda x: min(MOST_BITS, max(LEAST_BITS, (16 * x).bit_length()))
        self.bits, self.hot_bits = size(n), size(hot)
        self.all = spark.sparkContext.broadcast(bloom(keys, "key", self.bits))
        self.hot = spark.sparkContext.broadcast(bloom(keys.where("hot"), "key", self.hot_bits) if hot else bytes(1 << self.hot_bits - 3))
        self.parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (windows or 0) * 40 // HOT_BYTES)

    def may(self, keys: np.ndarray) -> np.ndarray:
        return Bloom(self.all.value, self.bits).may(keys)

    def may_be_hot(self, keys: np.ndarray) -> np.ndarray:
        return Bloom(self.hot.value, self.hot_bits).may(keys)


# --- what travels

#: A context (key not null), ranges that are decided already (owner not null), or hot windows.
SHIPPED = "part int, key long, doc long, ctx long, owner long, data binary, owners binary"
_SHIPPED = pa.schema([("part", pa.int32()), *((c, pa.int64()) for c in ("key", "doc", "ctx", "owner")), ("data", pa.binary()), ("owners", pa.binary())])


class Shipment:
    """The contexts of a batch of texts, each once.

    ``ordered``: a window repeats if a smaller id holds it too (else: if it starts anywhere else). Of a context's owners
    in the batch those that are decided thereby leave as ranges; the others (of smallest id; or the only one) go along.
    ``symbols`` turns a context's data into random 64-bit values.
    """

    def __init__(self, parts: int, length: int, ordered: bool, symbols: Callable[[bytes], np.ndarray], may_be_hot: Callable[[np.ndarray], np.ndarray]):
        self.parts, self.length, self.ordered, self.symbols, self.may_be_hot = parts, length, ordered, symbols, may_be_hot
        self.found: dict[int, tuple] = {}
        self.held = 0

    def add(self, key: int, ctx: int, data: bytes, n: int, doc: int, owner: int, first: int) -> None:
        while (old := self.found.get(ctx)) is not None and old[1] != data:
            ctx += 1  # equal hashes of differing contexts
        if old is None:
            self.found[ctx] = (key, data, n, [(doc, owner, first)])
            self.held += len(data) + 200
        else:
            old[3].append((doc, owner, first))
            self.held += 80

    def batch(self) -> pa.RecordBatch:
        rows: list[tuple] = []
        ranges: dict[int, list] = {}
        hot: list[tuple] = []
        keys = np.array([v[0] for v in self.found.values()], np.int64)
        for (ctx, (key, data, n, owners)), is_hot in zip(self.found.items(), self.may_be_hot(keys).tolist() if len(keys) else ()):
            if self.ordered:
                doc = min(owners)[0]
                own, done = [o for o in owners if o[0] == doc], [o for o in owners if o[0] > doc]
            else:
                doc, own, done = (1, owners, []) if len(owners) == 1 else (2, [], owners)
            for _, owner, first in done:
                ranges.setdefault(owner, []).append((first, first + n - 1 + self.length))
            if is_hot:
                hot += [(key, data, doc, owner, first) for _, owner, first in own] or [(key, data, doc, 0, -1)]
            else:
                rows.append((key % self.parts, key, doc, ctx, None, data, np.array([o[1:] for o in own], np.int64).tobytes()))
        rows += [(owner % self.parts, None, None, None, owner, packed(np.array(r)), None) for owner, r in ranges.items()]
        for a in range(0, len(hot), 2000):
            rows += self._windows(hot[a : a + 2000])
        self.found, self.held = {}, 0
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SHIPPED)], schema=_SHIPPED) if rows else pa.RecordBatch.from_pylist([], schema=_SHIPPED)

    def _windows(self, hot: list[tuple]) -> Iterator[tuple]:
        """Hot windows by shard, as arrays of (two hashes, owner, start, id); start -1: known to stand twice."""
        cols = []
        for key, data, doc, owner, first in hot:
            symbols = self.symbols(data)
            h = run_hashes(symbols, self.length)
            one = np.full(len(h), 1)
            cols.append((h ^ np.uint64(key & 0xFFFFFFFFFFFFFFFF), run_hashes(mix(symbols), self.length), one * owner, np.arange(len(h)) + first if first >= 0 else -one, one * doc))
        cols = [np.concatenate(x) for x in zip(*cols)]
        where = (cols[0] % np.uint64(self.parts)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        edge = np.searchsorted(where[order], np.arange(self.parts + 1))
        for p in np.flatnonzero(np.diff(edge)).tolist():
            o = order[edge[p] : edge[p + 1]]
            yield p, None, None, None, None, b"".join(x[o].tobytes() for x in cols), None


# --- what repeats

RANGES = "_key long, ranges binary"


def packed(ranges: np.ndarray) -> bytes:
    return ranges.astype("<i4").tobytes()


def ranges_of(starts: np.ndarray, length: int) -> np.ndarray:
    """What windows at sorted starts cover, as rows (start, end)."""
    cut_ = np.flatnonzero(np.diff(starts) > 1) + 1
    return np.stack((starts[np.concatenate(([0], cut_))], starts[np.concatenate((cut_ - 1, [len(starts) - 1]))] + length), axis=1)


def _hot_ranges(data: list[bytes], length: int, ordered: bool) -> Iterator[tuple[int, bytes]]:
    h, g, owner, start, doc = np.concatenate([np.frombuffer(x, np.int64).reshape(5, -1) for x in data], axis=1)
    order = np.lexsort((doc, start, g, h) if not ordered else (start, doc, g, h))
    h, g, owner, start, doc = h[order], g[order], owner[order], start[order], doc[order]
    first = np.concatenate(([True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])))
    at = np.flatnonzero(first)
    run = np.cumsum(first) - 1
    if ordered:
        on = np.flatnonzero(doc > doc[at][run])  # the first of a run has the smallest id
    else:
        on = np.flatnonzero(((np.diff(np.append(at, len(h))) > 1) | (start[at] < 0))[run] & (start >= 0))
    on = on[np.lexsort((start[on], owner[on]))]
    for x in np.split(on, np.flatnonzero(np.diff(owner[on])) + 1) if len(on) else ():
        yield int(owner[x[0]]), packed(ranges_of(np.unique(start[x]), length))


def decided(batches: Iterator[pa.RecordBatch], length: int, ordered: bool, decide: Callable[[Iterator[tuple[int, bytes, bytes]]], Iterator[tuple[bytes, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
    """Ranges by owner. ``decide`` takes the rows (id or number, data, owners) of a key and yields (owners, marked starts)."""
    hot: list[bytes] = []
    out: tuple[list, list] = ([], [])

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4000):
                yield from zip(*(batch.column(i).slice(a, 4000).to_pylist() for i in range(1, 7)))

    def flushed() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary())], names=["_key", "ranges"])
        out[0].clear()
        out[1].clear()
        return made

    def put(owner: int, ranges: bytes) -> None:
        out[0].append(owner)
        out[1].append(ranges)

    for key, group in groupby(rows(), lambda r: r[0]):
        if key is None:
            for _, _, _, owner, data, _ in group:
                if owner is None:
                    hot.append(data)
                else:
                    put(owner, data)
                if len(out[0]) > 20_000:
                    yield flushed()
        else:
            for owners, starts in decide((r[1], r[4], r[5]) for r in group):
                if len(starts):
                    ranges = ranges_of(starts, length)
                    for owner, first in np.frombuffer(owners, np.int64).reshape(-1, 2).tolist():
                        put(owner, packed(ranges + first))
            if len(out[0]) > 20_000:
                yield flushed()
    for found in _hot_ranges(hot, length, ordered) if hot else ():
        put(*found)
        if len(out[0]) > 20_000:
            yield flushed()
    yield flushed()


def united(pieces: DataFrame) -> DataFrame:
    """(_key, _pieces): the ranges of each text (equal ones once), bounded by the text's length."""
    return pieces.groupBy("_key").agg(F.collect_set("ranges").alias("_pieces"))


def covered(pieces: pa.Array, sizes: list[int]) -> Iterator[list[list[int]]]:
    """Sorted disjoint ranges, from the ranges that were found for each text."""
    for found, size in zip(pieces.to_pylist(), sizes):
        if not found:
            yield []
            continue
        ranges = np.frombuffer(b"".join(found), "<i4").reshape(-1, 2)
        cover = np.zeros(size + 1, np.int64)
        np.add.at(cover, ranges[:, 0], 1)
        np.add.at(cover, ranges[:, 1], -1)
        yield spans_of(np.cumsum(cover[:-1]) > 0).tolist()


class Bloom:
    """A Bloom filter of ``2**bits`` bits: what may be broadcast, as its size is bounded.

    It only thins out what is shuffled; false positives are told apart later, so a full filter costs time, never results.
    """

    def __init__(self, data: bytes, bits: int):
        self.table, self.bits = np.frombuffer(data, np.uint8), bits

    @staticmethod
    def places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        h = mix(keys.astype(np.int64).view(np.uint64).copy())
        low = np.uint64((1 << (bits - 6)) - 1)
        segment = h >> np.uint64(58)
        at = lambda x: ((segment << np.uint64(bits - 6)) | (x & low)).astype(np.int64)
        return at(h), at(h >> np.uint64(26) ^ h * np.uint64(5))

    def may(self, keys: np.ndarray) -> np.ndarray:
        p, q = self.places(keys, self.bits)
        bit = lambda x: (self.table[x >> 3] >> (x & 7).astype(np.uint8)) & 1
        return (bit(p) & bit(q)).astype(bool)


def bloom(df: DataFrame, col: str, bits: int) -> bytes:
    """The filter of a column of longs: 64 segments, each set by one task, ``2**bits / 8`` bytes in all."""
    size = 1 << (bits - 6)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.unique(np.concatenate(Bloom.places(batch.column(0).to_numpy(), bits)))
            edge = np.searchsorted(x >> (bits - 6), np.arange(65))
            full = np.flatnonzero(np.diff(edge))
            data = [(x[edge[s] : edge[s + 1]] & (size - 1)).astype("<i4").tobytes() for s in full]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(data, pa.binary())], names=["segment", "bits"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tables.setdefault(s, np.zeros(size, bool))[np.frombuffer(b, "<i4")] = True
        for s, t in tables.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.packbits(t, bitorder="little").tobytes()], pa.binary())], names=["segment", "bits"])

    schema = "segment int, bits binary"
    rows = df.select(col).mapInArrow(places, schema).repartitionById(64, F.col("segment")).mapInArrow(merged, schema).collect()
    found = {r["segment"]: bytes(r["bits"]) for r in rows}
    return b"".join(found.get(s, bytes(size // 8)) for s in range(64))
