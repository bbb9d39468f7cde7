"""Alignment of two tokenizers' tokens over the same bytes, and corpus-wide counts of the id pairs that they link.

A worker takes a block of texts, encodes each with both tokenizers and goes on in Arrow: ids are flattened with the text
they came from, cumulative sums of token lengths, begun anew with each text, give every token's end, and a hash join (Acero) on
(text, end) finds where tokens of both end: there the groups are cut. Every piece between neighbouring ends of either
side is a link of the A and the B token above it. A grouped count of the block's distinct (text, pair) gives
partial counts, which Spark adds up over the corpus. The counts go back to a block as the rows of the
pairs that it asked for (a join on the pair, then a cogroup by block), so nothing is broadcast, and texts are encoded once.

A is byte-level BPE (a file of the tokenizers library) over a blank and the text, B a sentencepiece model over the text, to which the model
adds that blank; special tokens' strings are plain text. B's pieces hold no blank after another character, so a text is
encoded by units (blanks and what follows), each once while it is remembered; models for which this does not hold raise.

Defined cases: null and empty texts, and texts whose joined A or B bytes differ from blank and text, have no tokens, groups or
links, and their ``groups`` is null; rows that repeat each count as a document; ids of documents may be null or repeat (rows
are not told by them); other columns pass through, but those named like the columns made here, which are replaced; an empty table gives no rows. A worker holds a block
(``BLOCK`` characters, or one text) with its distinct pairs, the tokens of a slice of it (``SLICE`` characters, or one text) and the
units met lately (``UNIT_BYTES``); a hot pair is a row for each block.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from sys import getsizeof

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from countloom.llm.bpe import Codec
from countloom.session import cut

#: Characters of a block, of a slice of it that is aligned at once, and bytes of the units that a worker remembers.
BLOCK, SLICE, UNIT_BYTES = 2 << 20, 1 << 18, 48 << 20
_UNIT = re.compile(" +[^ ]*")


class Pair:
    """Both tokenizers of a worker."""

    def __init__(self, a_path: str, b_path: str):
        a = Codec(a_path)
        self.a, self.a_bytes = a.encoding, a.bytes_of
        self.a_size = a.length
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        n = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(n)]
        if any(re.search("[^▁]▁", x) for x in pieces) or self.b.encode(" a  b ", out_type=str) != ["▁▁a", "▁▁b", "▁"] and "".join(self.b.encode(" a  b ", out_type=str)) != "▁▁a▁▁b▁":
            raise ValueError("this sentencepiece model does not encode blanks and what follows by themselves")
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) else x.replace("▁", " ").encode() for i, x in enumerate(pieces)]
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        self.blank = self.b.piece_to_id("▁")
        self.units: dict[str, bytes] = {}  # lately met ones, and those before them
        self.older: dict[str, bytes] = {}
        self.held = 0

    def encode_b(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of B; a unit whose bytes come out otherwise leaves its text without tokens."""
        split = [_UNIT.findall(" " + x) for x in texts]
        entered = [x for x in set().union(*split) if x not in self.units]
        new = [x for x in entered if x not in self.older]
        self.units.update((x, self.older.pop(x)) for x in entered if x in self.older)
        found = [[self.blank] if x == " " else ids for x, ids in zip(new, self.b.encode([x[1:] for x in new], num_threads=1) if new else [])]
        want, sizes = [x.encode() for x in new], self.b_size[np.fromiter(chain.from_iterable(found), np.int64)]
        upto = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum([0, *map(len, found)])]
        if not np.array_equal(np.diff(upto), np.fromiter(map(len, want), np.int64)) or b"".join(map(self.b_bytes.__getitem__, chain.from_iterable(found))) != b"".join(want):
            found = [ids if b"".join(map(self.b_bytes.__getitem__, ids)) == x else [-1] for ids, x in zip(found, want)]
        self.units.update(zip(new, (array("i", ids).tobytes() for ids in found)))
        self.held += sum(map(getsizeof, entered)) + sum(map(getsizeof, map(self.units.__getitem__, entered))) + 100 * len(entered)
        out = [np.frombuffer(b"".join(map(self.units.__getitem__, x)), "<i4") for x in split]
        if self.held > UNIT_BYTES // 2:
            self.older, self.units, self.held = (self.units if self.held <= UNIT_BYTES else {}), {}, 0
        return [x if not len(x) or x.min() >= 0 else x[:0] for x in out]

    def encode_a(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(self.a.encode_ordinary(" " + x), np.int32) for x in texts]


@lru_cache(maxsize=1)
def tokenizers(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def _listed(ids: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate([*ids, np.empty(0, np.int32)]).astype(np.int32)))


def _ends(ids: pa.ListArray, size: np.ndarray) -> pa.Table:
    """(text, end, id, place): a row for each token; ends count from the text's own start."""
    flat, text = ids.flatten(), pc.list_parent_indices(ids).cast(pa.int64())
    total = pc.cumulative_sum(pa.array(size).take(flat))
    last = np.concatenate(([0], total.to_numpy()))[ids.offsets.to_numpy()[:-1]]  # what stands before each text
    return pa.table({"text": text, "end": pc.subtract(total, pa.array(last).take(text)), "id": flat, "place": pa.array(np.arange(len(flat)))})


def _aligned(a_ids: list[np.ndarray], b_ids: list[np.ndarray], a_size: np.ndarray, b_size: np.ndarray) -> tuple[pa.Table, pa.Table, list[pa.ListArray]]:
    """(groups: text, a_stop, b_stop; links: text, a, b; ids by text) of texts in their order; stops count over the block."""
    listed = [_listed(a_ids), _listed(b_ids)]
    a, b = _ends(listed[0], a_size), _ends(listed[1], b_size)
    both = a.select(["text", "end", "place"]).join(b.select(["text", "end", "place"]), keys=["text", "end"], join_type="inner", right_suffix="_b", use_threads=False)
    a_stop, b_stop = (np.sort(both[c].to_numpy()) + 1 for c in ("place", "place_b"))  # both rise together
    groups = pa.table({"text": a["text"].take(pa.array(a_stop - 1)), "a_stop": a_stop, "b_stop": b_stop})
    # ends over the whole block are in order, and those of both sides are ends of A already
    wide = np.concatenate(([0], np.cumsum([int(a_size[x].sum()) for x in a_ids])))
    a_end, b_end = (x["end"].to_numpy() + wide[x["text"].to_numpy()] for x in (a, b))
    alone = np.ones(len(b_end), bool)
    alone[b_stop - 1] = False
    before = np.searchsorted(a_end, b_end[alone])  # the A token above each end that B alone has
    edge = np.insert(a_end, before, b_end[alone])
    i = np.insert(np.arange(len(a_end)), before, before)
    step = np.zeros(len(edge), bool)  # where a B token ended just before
    at_a = np.zeros(len(a_end), bool)
    at_a[a_stop - 1] = True
    step[1:] = np.insert(at_a, before, True)[:-1]
    j = np.cumsum(step)
    links = pa.table({"text": a["text"].take(pa.array(i)), "a": a["id"].take(pa.array(i)), "b": b["id"].take(pa.array(j))})
    return groups, links, listed


def _said(groups: pa.Table, listed: list[pa.ListArray], n: int) -> pa.Array:
    """`a1,a2|b1;a3|b2` of each text, null without tokens."""
    sides = []
    for ids, stop in zip(listed, ("a_stop", "b_stop")):
        offsets = pa.array(np.concatenate(([0], groups[stop].to_numpy())), pa.int32())
        sides.append(pc.binary_join(pa.ListArray.from_arrays(offsets, ids.flatten().cast(pa.string())), ","))
    said = pc.binary_join_element_wise(*sides, "|")
    per_text = np.bincount(groups["text"].to_numpy(), minlength=n)
    out = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(per_text))), pa.int32()), said), ";")
    return pc.if_else(pa.array(per_text > 0), out, pa.scalar(None, pa.string()))


_MADE = {"n_a": T.LongType(), "n_b": T.LongType(), "n_groups": T.LongType(), "n_links": T.LongType(), "groups": T.StringType()}
_COUNTS = {"n_best": T.LongType(), "count_sum": T.LongType()}


def _blocks(batches: Iterator[pa.RecordBatch], text_at: int, most: int | None = None) -> Iterator[pa.Table]:
    """Tables of about ``most`` (BLOCK) characters of text."""
    rows, size, most = [], 0, most or BLOCK
    for batch in batches:
        lens = pc.fill_null(pc.utf8_length(batch.column(text_at)), 0).to_numpy()
        start = 0
        for i, n in enumerate(lens.tolist()):
            size += n
            if size >= most:
                block = pa.Table.from_batches([*rows, batch.slice(start, i + 1 - start)]).combine_chunks()
                rows, size, start = [], 0, i + 1  # the batch before may go
                yield block
        if start < batch.num_rows:
            rows.append(batch.slice(start))
    if rows:
        yield pa.Table.from_batches(rows).combine_chunks()


def _packed(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, kind: str, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def align(docs: DataFrame, a_path: str, b_path: str, *, text_col: str = "text", digest=None) -> DataFrame:
    """``docs`` with n_a, n_b, n_groups, n_links, groups, n_best and count_sum.

    ``groups``: `a1,a2|b1;a3|b2,b3`, ids in order. n_best: links whose pair's count is the highest of its A id in the
    corpus; count_sum: counts over links; a pair's count is the number of documents that hold it linked. ``digest`` is a function of
    texts that is stored instead of ``groups`` (the groups are about twice as long as the texts).
    """
    names = [c for c in docs.columns if c not in _MADE | _COUNTS]
    base = docs.select(*[F.col(f"`{c}`") for c in names])
    kept = [c for c in names if c != text_col or digest is None]
    text_at = names.index(text_col)
    row = T.StructType([*(base.schema[c] for c in kept), *(T.StructField(k, v) for k, v in _MADE.items())])
    # a row for each block: its documents, its distinct pairs with their documents, and which pairs each document has, how often
    schema = T.StructType([
        T.StructField("block", T.StringType()), T.StructField("docs", T.ArrayType(row)), T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("in_docs", T.ArrayType(T.LongType())),
        T.StructField("starts", T.BinaryType()), T.StructField("pair_at", T.BinaryType()), T.StructField("times", T.BinaryType()),
    ])

    def slice_of(part: pa.Table, pair: Pair) -> tuple[list[pa.Array], pa.Table, np.ndarray]:
        """The columns of ``row``; pairs with how often each text holds them, by text and pair; how many pairs each text has."""
        texts = [x or "" for x in part.column(text_at).to_pylist()]
        n = len(texts)
        a_ids, b_ids = pair.encode_a(texts), pair.encode_b(texts)
        for i, x in enumerate(texts):
            size = len(x.encode()) + 1
            if not x or int(pair.a_size[a_ids[i]].sum()) != size or int(pair.b_size[b_ids[i]].sum()) != size:
                a_ids[i] = b_ids[i] = np.empty(0, np.int32)
        groups, links, listed = _aligned(a_ids, b_ids, pair.a_size, pair.b_size)
        key = pc.add(pc.shift_left(links["a"].cast(pa.int64()), 32), links["b"].cast(pa.int64()))
        held = pa.table({"text": links["text"], "pair": key}).group_by(["text", "pair"], use_threads=False).aggregate([([], "count_all")])
        held = held.sort_by([("text", "ascending"), ("pair", "ascending")])
        per_text = lambda t: np.bincount(t["text"].to_numpy(), minlength=n)
        said = _said(groups, listed, n)
        cols = [part.column(c).combine_chunks() for c in kept] + [pa.array(x, pa.int64()) for x in (list(map(len, a_ids)), list(map(len, b_ids)), per_text(groups), per_text(links))]
        cols.append(said if digest is None else pa.array([x if x is None else digest(x) for x in said.to_pylist()], pa.string()))
        return [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in cols], pa.table({"pair": held["pair"], "times": held["count_all"].cast(pa.int32())}), per_text(held)

    def row_of(name: str, block: pa.Table, pair: Pair) -> pa.RecordBatch:
        cols, held, per_text = zip(*(slice_of(x, pair) for x in _blocks(iter(block.to_batches()), text_at, SLICE)))
        made = pa.StructArray.from_arrays([pa.concat_arrays(c) for c in zip(*cols)], names=row.names)
        held, starts = pa.concat_tables(held), np.concatenate(([0], np.cumsum(np.concatenate(per_text)))).astype(np.int64)
        counts = held.group_by("pair", use_threads=False).aggregate([([], "count_all")]).sort_by("pair")
        pairs = counts["pair"].combine_chunks()
        at = np.searchsorted(pairs.to_numpy(), held["pair"].to_numpy()).astype(np.int32)
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        return pa.RecordBatch.from_arrays([
            pa.array([name]), one(made), one(pairs), one(counts["count_all"].combine_chunks()), *(pa.array([_packed(x)], pa.binary()) for x in (starts, at, held["times"].to_numpy())),
        ], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, part = tokenizers(a_path, b_path), TaskContext.get().partitionId()
        for k, block in enumerate(_blocks(batches, text_at)):
            yield row_of(f"{part}-{k}", block, pair)
            pa.default_memory_pool().release_unused()  # workers live on between tasks

    blocks = cut(base.mapInArrow(run, schema), "aligned")
    asked = blocks.select("block", F.explode(F.arrays_zip("pairs", "in_docs")).alias("x")).select("block", F.col("x.pairs").alias("pair"), F.col("x.in_docs").alias("n"))
    total = asked.groupBy("pair").agg(F.sum("n").alias("n"))
    total = cut(total.withColumn("a", F.shiftright("pair", 32)), "pair-counts")
    best = total.groupBy("a").agg(F.max("n").alias("best"))
    total = total.join(best, "a").select("pair", "n", (F.col("n") == F.col("best")).alias("best"))
    told = asked.select(F.col("block").alias("of"), "pair").join(total, "pair")

    def score(block: pa.Table, told: pa.Table) -> pa.Table:
        """n_best and count_sum of a block's texts, in their order."""
        told = told.sort_by("pair")
        starts, at, times = (block[c][0].as_py() for c in ("starts", "pair_at", "times"))
        starts = _unpacked(starts, "<i8", block["n"][0].as_py() + 1)
        at, times = (_unpacked(x, "<i4", int(starts[-1])) for x in (at, times))
        sums = []
        for x in (told["best"].cast(pa.int64()).to_numpy(), told["n"].to_numpy()):
            upto = np.concatenate(([0], np.cumsum(x[at] * times.astype(np.int64))))
            sums.append(pa.array(upto[starts[1:]] - upto[starts[:-1]]))
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        return pa.table({"block": block["block"], **{k: one(x) for k, x in zip(_COUNTS, sums)}})

    sums = blocks.select("block", F.size("docs").alias("n"), "starts", "pair_at", "times").groupBy("block").cogroup(told.groupBy("of"))
    sums = sums.applyInArrow(score, T.StructType([blocks.schema["block"], *(T.StructField(k, T.ArrayType(v)) for k, v in _COUNTS.items())]))
    found = blocks.select("block", "docs").join(sums, "block").select(F.inline(F.arrays_zip("docs", *_COUNTS)))
    return found.select("docs.*", *_COUNTS)
