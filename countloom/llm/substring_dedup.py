"""Substring dedup with suffix automata: words covered by a window of ``window`` words that also starts in a document of
smaller id are removed.

``against`` takes a reference of bounded size: the automata of its shards are broadcast (their size is checked first), and
documents are streamed against them for matching statistics.

``dedup`` takes the corpus as its own reference. That has no size bound, so its automata are not broadcast; reference and
documents meet by shard instead: contexts that share an anchor (see ``anchors``) come to one shard in the order of ids, are
streamed for matching statistics against the suffix automata of the contexts before them, and their unmatched parts
are then added. A state knows the document of its first end position, which is the smallest, as contexts come in order
of ids. An automaton takes up to ``SHARD_WORDS`` words; a shard that needs more opens another, and documents are streamed
against each, so memory stays bounded per automaton. Words are compared as they are, not as hashes. What is broadcast
are Bloom filters of bounded size, which keep away the contexts whose anchor stands in one document only.

Two things pass beside the automata. Copies of a context inside a batch of documents travel once: they are compared word
for word, and all but those of smallest id repeat. A hot anchor (a line that very many documents hold, each going on
differently) would bring all its contexts to one task: its contexts are dealt window by window, and equal windows meet
their smallest id there, by 128 bits of their hash.

Null texts have no words; documents with a null id keep all words and are no reference. Rows that repeat an id keep what
they hold (no smaller id). Ids are integers (others raise). Windows are judged on the input. Other columns pass through,
but for ``n_words``, ``removed`` and ``kept``, which are replaced. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from countloom.llm.anchors import COUNTS, RANGES, SHIPMENT_BYTES, SHIPPED, Filters, Shipment, anchors, batch_counts, chosen, context_hash, covered, decided, packed, ranges_of, united
from countloom.llm.common import WordHashes, byte_column, private, require_integer, spans_of
from countloom.session import cut

GRAM = 16
SHARD_WORDS = 60_000
#: Most words of a reference whose automata are broadcast (about 500 bytes each in a worker).
REFERENCE_WORDS = 1_000_000


class Automaton:
    """A suffix automaton over several sequences, built online."""

    __slots__ = ("next", "link", "len", "doc", "size")

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.len, self.doc, self.size = [-1], [0], [None], 0

    def _state(self, length: int, doc: int, edges: dict, link: int) -> int:
        self.next.append(edges)
        self.len.append(length)
        self.doc.append(doc)
        self.link.append(link)
        return len(self.len) - 1

    def add(self, words: list[bytes], doc: int) -> None:
        last, nxt, link, length = 0, self.next, self.link, self.len
        self.size += len(words)
        for w in words:
            q = nxt[last].get(w)
            if q is not None:  # another sequence came this way
                if length[q] == length[last] + 1:
                    last = q
                    continue
                clone = self._state(length[last] + 1, self.doc[q], dict(nxt[q]), link[q])
                link[q] = clone
                p = last
                while p >= 0 and nxt[p].get(w) == q:
                    nxt[p][w] = clone
                    p = link[p]
                last = clone
                continue
            now = self._state(length[last] + 1, doc, {}, 0)
            p = last
            while p >= 0 and w not in nxt[p]:
                nxt[p][w] = now
                p = link[p]
            if p >= 0:
                q = nxt[p][w]
                if length[q] == length[p] + 1:
                    link[now] = q
                else:
                    clone = self._state(length[p] + 1, self.doc[q], dict(nxt[q]), link[q])
                    link[q] = link[now] = clone
                    while p >= 0 and nxt[p].get(w) == q:
                        nxt[p][w] = clone
                        p = link[p]
            last = now

    def matches(self, words: list[bytes], window: int, doc: int, marked: np.ndarray, known: np.ndarray) -> None:
        """Marks the window starts of ``words`` that occur in a document before ``doc``, and those known at all."""
        nxt, link, length, first = self.next, self.link, self.len, self.doc
        state, n = 0, 0
        for i, w in enumerate(words):
            q = nxt[state].get(w)
            while q is None and state:
                state = link[state]
                n = length[state]
                q = nxt[state].get(w)
            if q is None:
                n = 0
                continue
            state = q
            n += 1
            if n >= window:
                while length[link[state]] >= window:  # the state that holds the window itself
                    state = link[state]
                    n = length[state]
                known[i - window + 1] = True
                if first[state] < doc:
                    marked[i - window + 1] = True


def repeated(contexts: Iterator[tuple[int, list[bytes]]], window: int) -> Iterator[np.ndarray]:
    """For contexts in order of ids: which window starts occur in a document of smaller id."""
    shards: list[Automaton] = []
    new: list[tuple[int, list[bytes]]] = []  # what the last context brought; it is added only if another one comes
    for doc, words in contexts:
        for old, part in new:
            if not shards or shards[-1].size >= SHARD_WORDS:
                shards.append(Automaton())
            shards[-1].add(part, old)
        starts = len(words) - window + 1
        marked, known = np.zeros(starts, bool), np.zeros(starts, bool)
        for shard in shards:
            shard.matches(words, window, doc, marked, known)
        new = [(doc, words[a : b + window - 1]) for a, b in spans_of(~known).tolist()] if shards else [(doc, words)]
        yield marked


def _texts(batch: pa.RecordBatch, window: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """(row key, id, words) of the texts that hold a window."""
    for owner, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), byte_column(batch, batch.schema.names[2])):
        if doc is not None and text and len(text) >= 2 * window - 1 and len(words := text.split()) >= window:
            yield owner, doc, words


def _chosen_keys(texts: DataFrame, window: int, k: int) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows, size = [], 0
            for _, doc, words in _texts(batch, window):
                symbols = hashes.of(words)
                view = memoryview(symbols).cast("B")
                for key, place, first, end in anchors(symbols, window, k):
                    rows.append((key, [context_hash(view[8 * a : 8 * (b + window - 1)], p - a) for a, b, p in zip(first.tolist(), end.tolist(), place.tolist())], doc))
                    size += len(key)
                if size > 400_000:
                    yield batch_counts(rows)
                    rows, size = [], 0
            yield batch_counts(rows)

    return cut(chosen(texts.mapInArrow(count, COUNTS), "first < last"), "keys")


def removals(keyed: DataFrame, *, window: int, k: int, id_col: str, text_col: str) -> DataFrame:
    """(_key, _pieces): for each text the word ranges that its repeated windows cover."""
    texts = keyed.select("_key", F.col(id_col).cast("long").alias("_id"), text_col)
    filters = Filters(_chosen_keys(texts, window, k), window - k + 1)

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        shipment = Shipment(filters.parts, window, True, lambda data: hashes.of(data.split(b" ")), filters.may_be_hot)
        for batch in batches:
            for owner, doc, words in _texts(batch, window):
                symbols = hashes.of(words)
                view = memoryview(symbols).cast("B")
                for key, place, first, end in anchors(symbols, window, k):
                    on = np.flatnonzero(filters.may(key))
                    for x, p, a, b in zip(key[on].tolist(), place[on].tolist(), first[on].tolist(), end[on].tolist()):
                        shipment.add(x, context_hash(view[8 * a : 8 * (b + window - 1)], p - a), b" ".join(words[a : b + window - 1]), b - a, doc, owner, a)
                if shipment.held > SHIPMENT_BYTES:
                    yield shipment.batch()
        yield shipment.batch()

    def bucket(rows: Iterator[tuple[int, bytes, bytes]]) -> Iterator[tuple[bytes, np.ndarray]]:
        """The contexts of one key, in the order of ids: (id, data, owners)."""
        held: list[bytes] = []

        def contexts() -> Iterator[tuple[int, list[bytes]]]:
            for doc, data, own in rows:
                held.append(own)
                yield doc, data.split(b" ")

        for marked in repeated(contexts(), window):
            yield held.pop(), np.flatnonzero(marked)

    shipped = texts.mapInArrow(ship, SHIPPED).repartitionById(filters.parts, F.col("part")).sortWithinPartitions("key", "doc", "ctx")
    return united(shipped.mapInArrow(lambda batches: decided(batches, window, True, bucket), RANGES))


def _applied(base: DataFrame, joined: DataFrame, text_col: str) -> DataFrame:
    """``base``'s columns of ``joined`` with ``n_words``, ``removed`` and ``kept``, from ``_pieces``."""
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*base.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("removed", span), T.StructField("kept", T.StringType())])
    names = base.columns
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, kept = [], []
            texts = [x.split() if x else [] for x in byte_column(batch, text_col)]
            n_words = [len(x) for x in texts]
            pieces = batch.column(batch.schema.get_field_index("_pieces"))
            for words, found in zip(texts, covered(pieces, n_words)):
                spans.append([{"start": a, "end": b} for a, b in found])
                if found:
                    edges = [0, *(x for s in found for x in s), len(words)]
                    words = [w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b]]
                kept.append(b" ".join(words).decode())
            old = {c: batch.column(batch.schema.get_field_index(c)) for c in names}
            yield pa.RecordBatch.from_pydict(old | {"n_words": pa.array(n_words, pa.int64()), "removed": pa.array(spans, spans_type), "kept": pa.array(kept, pa.string())})

    return joined.mapInArrow(apply, schema)


_MADE = ("n_words", "removed", "kept")


@private("_key", "_pieces", "_id")
def dedup(docs: DataFrame, *, window: int = 50, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM) -> DataFrame:
    """``docs`` with ``n_words``, ``removed`` (sorted word ranges, end exclusive) and ``kept`` (the other words, joined by blanks)."""
    require_integer(docs, id_col)
    base = docs.drop(*_MADE)
    keyed = base.withColumn("_key", F.xxhash64(id_col, text_col))
    pieces = removals(keyed, window=window, k=gram, id_col=id_col, text_col=text_col)
    return _applied(base, keyed.join(pieces, "_key", "left"), text_col)


@lru_cache(maxsize=1)
def _automata(texts: tuple[bytes, ...]) -> list[Automaton]:
    """The automata of a reference, built once by a worker."""
    shards: list[Automaton] = []
    for text in texts:
        if not shards or shards[-1].size >= SHARD_WORDS:
            shards.append(Automaton())
        shards[-1].add(text.split(), 0)
    return shards


@private("_pieces")
def against(docs: DataFrame, reference: DataFrame, *, window: int = 50, text_col: str = "text", reference_col: str = "text", reference_words: int = REFERENCE_WORDS) -> DataFrame:
    """As ``dedup``, but words go that are covered by a window of a text of ``reference``, whose automata are broadcast.

    Raises if the reference has more than ``reference_words`` words (counted first).
    """
    words = F.size(F.regexp_extract_all(F.col(reference_col), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    size = reference.where(F.col(reference_col).isNotNull()).agg(F.sum(words)).first()[0] or 0
    if size > reference_words:
        raise ValueError(f"the reference has {size} words; at most {reference_words} are broadcast")
    texts = tuple(r[0].encode() for r in reference.where(F.col(reference_col).isNotNull()).select(reference_col).collect())
    held = docs.sparkSession.sparkContext.broadcast(texts)
    base = docs.drop(*_MADE)
    names = base.columns
    pieces = T.StructType([*base.schema.fields, T.StructField("_pieces", T.ArrayType(T.BinaryType()))])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in byte_column(batch, text_col):
                words = text.split() if text else []
                marked = np.zeros(max(0, len(words) - window + 1), bool)
                for automaton in _automata(held.value) if len(marked) else ():
                    automaton.matches(words, window, 1, marked, marked)
                found.append([packed(ranges_of(np.flatnonzero(marked), window))] if marked.any() else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.binary()))], names=[*names, "_pieces"])

    return _applied(base, base.mapInArrow(stream, pieces), text_col)
