"""Benchmark decontamination.

The normalised n-grams of the benchmark are broadcast as a hash set: sorted 64-bit hashes, each with the place of its
window in the items' words, about 50 bytes a word in all. It is built once, and ``INDEX_BYTES`` bounds it; a benchmark with
a larger set goes through in blocks, each of which reads the documents once and keeps only its hits, which are joined to
the documents in the end. Training documents are scanned window by window, hash hits are verified against the words
themselves, and either the hit spans or the whole documents go.

Words: A-Z is lower-cased, a word is a run of characters outside ``[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``.
A window is ``n`` consecutive words of an item; an item of fewer words (not none) is one window.
Null and empty texts have no words, no hits and are kept. Null items and items without words match nothing.
An empty benchmark matches nothing, an empty table gives no rows.
Repeated rows are scanned each for itself. Other columns pass through; a column named like an output of
``scan`` is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from countloom.llm.common import MULT, WordHashes, byte_column, private, spans_of
from countloom.session import cut

_KEEP = re.compile(rb"[0-9a-z\x80-\xff]")
#: Upper to lower case, anything that ends a word to a blank.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if _KEEP.match(bytes([c])) else 32 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Most bytes of an index in one broadcast, and what a word of the benchmark takes in it.
INDEX_BYTES, WORD_BYTES = 64 << 20, 50


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(TABLE).split() if text else []


def _roll(h: np.ndarray, own: np.ndarray, size: int) -> np.ndarray:
    """Hashes of runs of ``size`` words from those of runs of ``size`` - 1."""
    return h[:-1] * MULT + own[size - 1 :]


class Grams:
    """The windows of a block of items, by length: a table over the hashes' top bits, then sorted hashes, then the words."""

    def __init__(self, pieces: list[tuple[str, list[bytes]]], n: int):
        self.n, self.names = n, sorted({item for item, _ in pieces})
        number = {item: i for i, item in enumerate(self.names)}
        hashes, found, self.text, ends = WordHashes(), {}, b" ".join(w for _, words in pieces for w in words), []
        at = 0
        for item, words in pieces:
            size = min(n, len(words))
            own = h = hashes.of(words)
            for k in range(2, size + 1):
                h = _roll(h, own, k)
            if size:
                found.setdefault(size, []).append((h, np.arange(at, at + len(h)), np.full(len(h), number[item])))
            ends += map(len, words)
            at += len(words)
        self.end = np.cumsum(np.array(ends, np.int64) + 1) - 1  # of each word in the text
        self.begin = self.end - np.array(ends, np.int64)
        self.sizes = {}
        for size, parts in found.items():
            h, place, item = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(h, kind="stable")
            bits = max(12, (8 * len(h)).bit_length())
            table = np.zeros(1 << bits, bool)
            table[(h * MULT) >> np.uint64(64 - bits)] = True
            self.sizes[size] = (table, np.uint64(64 - bits), h[order], place[order].astype(np.int32), item[order].astype(np.int32))

    def hits(self, words: list[bytes], hashes: WordHashes) -> tuple[np.ndarray, set[str]]:
        """Hit words, and the items whose windows occur."""
        mask, items = np.zeros(len(words), bool), set()
        own = h = hashes.of(words)
        for size in range(1, min(self.n, len(words)) + 1):
            h = _roll(h, own, size) if size > 1 else h
            if size in self.sizes:
                table, shift, known, place, item = self.sizes[size]
                at = np.flatnonzero(table[(h * MULT) >> shift])
                lo, hi = np.searchsorted(known, h[at]), np.searchsorted(known, h[at], "right")
                for i, a, b in zip(at.tolist(), lo.tolist(), hi.tolist()):
                    gram = b" ".join(words[i : i + size]) if a < b else b""
                    for p, name in zip(place[a:b].tolist(), item[a:b].tolist()):
                        if self.text[self.begin[p] : self.end[p + size - 1]] == gram:
                            mask[i : i + size] = True
                            items.add(self.names[name])
        return mask, items


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, n: int, limit: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """(item, words) in blocks of at most ``limit`` words; a longer item is cut into pieces that overlap by n - 1 words."""
    rows = benchmark.select(F.col(id_col).cast("string"), F.encode(F.col(text_col), "UTF-8")).where(F.col(text_col).isNotNull())
    block, size = [], 0
    for item, text in rows.toLocalIterator():
        words = words_of(bytes(text))
        step = max(1, limit - n + 1)
        for a in range(0, max(1, len(words) - n + 1), step):
            piece = words[a : a + step + n - 1]
            if block and size + len(piece) > limit:
                yield block
                block, size = [], 0
            block.append((str(item), piece))
            size += len(piece)
    yield block


_MADE = ("n_words", "hit_spans", "hit_items")
_HITS = [T.StructField("n_words", T.LongType()), T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("hit_items", T.ArrayType(T.StringType()))]
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _scanned(docs: DataFrame, block: list, n: int, text_col: str) -> DataFrame:
    """``docs`` with the hits of one block."""
    base = docs.drop(*_MADE)
    names = base.columns
    grams = docs.sparkSession.sparkContext.broadcast(Grams(block, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, hashes = grams.value, WordHashes()
        for batch in batches:
            counts, spans, items = [], [], []
            for text in byte_column(batch, text_col):
                words = words_of(text)
                mask, found = index.hits(words, hashes)
                counts.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in spans_of(mask).tolist()])
                items.append(sorted(found))
            made = [pa.array(counts, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*names, *_MADE])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, *_HITS]))


@private("_text", "_spans", "_items")
def scan(docs: DataFrame, benchmark: DataFrame, *, n: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """``docs`` with ``n_words`` (long), ``hit_spans`` (array of word ranges, end exclusive) and ``hit_items`` (sorted strings)."""
    blocks = _blocks(benchmark, item_col, item_text_col, n, max(1, index_bytes // WORD_BYTES))
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return _scanned(docs, first, n, text_col)
    key = F.struct(F.xxhash64(text_col).alias("a"), F.hash(text_col).alias("b"), F.octet_length(text_col).alias("c"))
    texts = docs.select(text_col)
    hits = [cut(_scanned(texts, block, n, text_col).where(F.size("hit_items") > 0).select(key.alias("_text"), "hit_spans", "hit_items").distinct(), "hits") for block in (first, second, *blocks)]
    each = hits[0]
    for more in hits[1:]:
        each = each.unionByName(more)
    found = cut(each.groupBy("_text").agg(F.flatten(F.collect_list("hit_spans")).alias("_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_items")))).alias("_items")), "hits")  # a row a block at most
    base = docs.drop(*_MADE)
    joined = base.withColumn("_text", key).join(found, "_text", "left").drop("_text")
    names = base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, spans = [], []
            for text, found in zip(byte_column(batch, text_col), batch.column(len(names)).to_pylist()):
                counts.append(len(words_of(text)))
                mask = np.zeros(counts[-1], bool)
                for x in found or ():
                    mask[x["start"] : x["end"]] = True
                spans.append([{"start": a, "end": b} for a, b in spans_of(mask).tolist()])
            items = pa.array([x or [] for x in batch.column(len(names) + 1).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(counts, pa.int64()), pa.array(spans, _SPANS), items], names=[*names, *_MADE])

    return joined.mapInArrow(run, T.StructType([*base.schema.fields, *_HITS]))


def _without(text: str | None, spans: list) -> str | None:
    """``text`` without the words in ``spans``; what stands between two removed words goes with them."""
    if not spans:
        return text
    data = text.encode()
    at = [m.span() for m in _WORD.finditer(data)]
    kept, last = [], 0
    for s in spans:
        kept.append(data[last : at[s["start"]][0]])
        last = at[s["end"] - 1][1]
    return b"".join([*kept, data[last:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, mode: str = "documents", **options) -> DataFrame:
    """``docs`` without contaminated documents (``mode="documents"``) or without the hit spans (``mode="spans"``)."""
    text_col = options.get("text_col", "text")
    found = scan(docs, benchmark, **options)
    if mode == "documents":
        return found.where(F.size("hit_items") == 0).select(*docs.columns)
    if mode != "spans":
        raise ValueError("mode is 'documents' or 'spans'")
    names = found.columns

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {c: batch.column(i) for i, c in enumerate(names)}
            texts = [_without(x, spans) for x, spans in zip(at[text_col].to_pylist(), at["hit_spans"].to_pylist())]
            yield pa.RecordBatch.from_pydict(at | {text_col: pa.array(texts, at[text_col].type)})

    # texts without a hit do not pass through Python
    hit = F.size("hit_items") > 0
    return found.where(hit).mapInArrow(clean, found.schema).unionByName(found.where(~hit)).select(*docs.columns)
