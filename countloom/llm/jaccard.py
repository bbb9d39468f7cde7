"""Size-aware heavy-light join: all documents whose sets of word n-grams have a Jaccard similarity of at least t.

1. Sets. A document's set holds 64-bit hashes of its distinct n-grams of words; equal sets are one *node*, so copies
   collapse before anything is compared.
2. Inverted lists. (gram, node) entries go to buckets of the gram's hash space, packed and sorted; a bucket keeps the
   lists of two and more nodes. A pair needs an overlap of t times the larger set, so nodes with fewer shared grams
   than that leave; the others are *live* and know their shared grams, rarest first.
3. Light. Small sets enumerate all subsets of the overlap that a pair of sizes needs; nodes that meet under one
   subset link, without further counting. Stars (each to the smallest of the other side) stand for the pairs.
4. Heavy. Larger sets are looked up in the inverted lists of their prefix (the rarest grams, as many as a partner
   cannot miss); overlaps are counted on the live sets. To keep groups of near copies linear, each list is first
   compared with one hub (its member with the most widely shared grams). Lists whose members are then still in different
   components are compared in blocks: each pair of blocks of a list is one small task of its own, however long the list,
   and hands on only pairs of different components that pass the size and position filters. Pairs inside a component
   change nothing. The boundary between light and heavy is the size at which enumerating costs more than scanning, from counts over
   all live nodes.

Texts: A-Z is lower-cased; words are runs of bytes other than space and \\t..\\r; with fewer than n words the whole
sequence is the one gram; without words the set is empty and links with nothing. Null texts are empty. Rows that repeat
an id are linked through their own texts; a null id has a null component unless the set's other rows have ids.
Ids are integers (others raise). An empty table gives no rows. Other columns are not read. Hashes are 62 bits for grams and 64 for sets: two different sets of equal hash would count
as copies (odds about n*n/2^65).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from countloom.llm.common import WordHashes, byte_column, ngram_hashes, require_integer
from countloom.llm.components import components
from countloom.session import cut

SLICE = 2000
#: Members of a list that are compared at once, with as many others.
BLOCK = 512
GRAM_BITS = np.uint64(2)  # the top bits that are dropped, so that 7 bytes and a bucket of 64 tell a gram
_PACKED = "bucket int, nodes binary, sizes binary, counts binary, grams binary, lists binary"
_ARROW = pa.schema([("bucket", pa.int32()), ("nodes", pa.binary()), ("sizes", pa.binary()), ("counts", pa.binary()), ("grams", pa.binary()), ("lists", pa.binary())])


def gram_set(text: bytes | None, n: int, hashes: WordHashes) -> np.ndarray:
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = hashes.of(words)
    grams = ngram_hashes(h, n) if len(words) >= n else ngram_hashes(h, len(words))
    return np.unique(grams >> GRAM_BITS)


def set_hash(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)


def nodes(docs: DataFrame, *, n: int, id_col: str, text_col: str) -> DataFrame:
    """(id, node, size) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            node, size = [], []
            for text in byte_column(batch, text_col):
                g = gram_set(text, n, hashes)
                node.append(set_hash(g))
                size.append(len(g))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node, pa.int64()), pa.array(size, pa.int64())], names=["id", "node", "size"])

    return docs.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(run, "id long, node long, size long")


def _u7(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def _from_u7(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(data, np.uint8).reshape(-1, 7)
    return out.reshape(-1).view("<u8")


def _runs(x: np.ndarray) -> np.ndarray:
    """Starts of runs of equal values, and the end."""
    return np.concatenate((np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))), [len(x)])) if len(x) else np.array([0])


def _packed(bucket: np.ndarray, node: np.ndarray, size: np.ndarray, gram: np.ndarray, lists: np.ndarray | None) -> pa.RecordBatch:
    """Entries as one row a bucket, grouped by node."""
    order = np.lexsort((node, bucket))
    bucket, node, size, gram = bucket[order], node[order], size[order], gram[order]
    lists = None if lists is None else lists[order]
    rows, at = [], _runs(bucket)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        r = _runs(node[a:b]) + a
        rows.append((int(bucket[a]), node[r[:-1]].tobytes(), size[r[:-1]].astype("<u4").tobytes(), np.diff(r).astype("<u4").tobytes(), _u7(gram[a:b]) if lists is None else gram[a:b].tobytes(), None if lists is None else lists[a:b].astype("<u4").tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW) if rows else pa.RecordBatch.from_pylist([], schema=_ARROW)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows by bucket; a partition holds one bucket (or sorted ones)."""
    held, now = [], None
    for batch in batches:
        for i in range(batch.num_rows):
            row = {f.name: batch.column(j)[i].as_py() for j, f in enumerate(batch.schema)}
            if held and row["bucket"] != now:
                yield now, held
                held = []
            now = row["bucket"]
            held.append(row)
    if held:
        yield now, held


def _unpack(rows: list[dict], packed7: bool) -> tuple[np.ndarray, ...]:
    counts = [np.frombuffer(r["counts"], "<u4") for r in rows]
    node = np.concatenate([np.repeat(np.frombuffer(r["nodes"], "<i8"), c) for r, c in zip(rows, counts)])
    size = np.concatenate([np.repeat(np.frombuffer(r["sizes"], "<u4"), c) for r, c in zip(rows, counts)])
    gram = np.concatenate([_from_u7(r["grams"]) if packed7 else np.frombuffer(r["grams"], "<u8") for r in rows])
    lists = None if packed7 else np.concatenate([np.frombuffer(r["lists"], "<u4") for r in rows])
    return node, size, gram, lists


def live_sets(docs: DataFrame, *, n: int, num: int, den: int, text_col: str) -> DataFrame:
    """(node, size, grams, score): nodes that share enough grams to link, with their shared grams, rarest list first."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(6, (parts - 1).bit_length())
    shift = np.uint64(62 - bits)
    low = np.uint64((1 << 56) - 1)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            texts = byte_column(batch, text_col)
            for at in range(0, len(texts), SLICE):
                sets: dict[int, np.ndarray] = {}
                for text in texts[at : at + SLICE]:
                    if len(g := gram_set(text, n, hashes)):
                        sets.setdefault(set_hash(g), g)
                if not sets:
                    continue
                lens = np.array([len(g) for g in sets.values()])
                gram = np.concatenate(list(sets.values()))
                yield _packed((gram >> shift).astype(np.int32), np.repeat(np.array(list(sets), np.int64), lens), np.repeat(lens, lens), gram, None)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _buckets(batches):
            node, size, gram, _ = _unpack(rows, True)
            gram = (gram & low) | (np.uint64(bucket) << shift)
            order = np.lexsort((node, gram))
            node, size, gram = node[order], size[order], gram[order]
            once = np.concatenate(([True], (gram[1:] != gram[:-1]) | (node[1:] != node[:-1])))
            node, size, gram = node[once], size[once], gram[once]
            length = np.diff(r := _runs(gram))
            length = np.repeat(length, length)
            keep = length > 1
            if keep.any():
                owner = ((node[keep].view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(64 - bits)).astype(np.int32)
                yield _packed(owner, node[keep], size[keep], gram[keep], length[keep])

    schema = pa.schema([("node", pa.int64()), ("size", pa.int64()), ("grams", pa.list_(pa.int64())), ("score", pa.float64())])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _buckets(batches):
            node, size, gram, lists = _unpack(rows, False)
            order = np.lexsort((gram, lists, node))
            node, size, gram, lists = node[order], size[order], gram[order], lists[order]
            r = _runs(node)
            have, first = np.diff(r), r[:-1]
            ok = have * den >= num * size[first].astype(np.int64)
            score = np.add.reduceat(np.log2(lists.astype(float)), first) / size[first]
            mask = np.repeat(ok, have)
            offsets = np.concatenate(([0], np.cumsum(have[ok]))).astype(np.int32)
            grams = pa.ListArray.from_arrays(pa.array(offsets), pa.array(gram[mask].view(np.int64)))
            out = pa.RecordBatch.from_arrays([pa.array(node[first][ok]), pa.array(size[first][ok].astype(np.int64)), grams, pa.array(score[ok])], schema=schema)
            for at in range(0, out.num_rows, SLICE):
                yield out.slice(at, SLICE)
        pa.default_memory_pool().release_unused()  # workers live on between tasks

    size = 1 << bits
    first = docs.select(text_col).mapInArrow(entries, _PACKED).repartitionById(size, F.col("bucket"))
    second = first.mapInArrow(shared, _PACKED).repartitionById(size, F.col("bucket"))
    return second.mapInArrow(gathered, "node long, size long, grams array<long>, score double")


def need(a: int, b: int, num: int, den: int) -> int:
    """The least overlap with which sets of ``a`` and ``b`` grams link."""
    return -(-num * (a + b) // (num + den))


def subset_cost(size: int, num: int, den: int) -> int:
    """How many subsets a set enumerates for all partner sizes."""
    return sum(math.comb(size, c) for t in range(-(-num * size // den), den * size // num + 1) if (c := need(size, t, num, den)) <= min(size, t))


def boundary(live: DataFrame, num: int, den: int, most: int = 40) -> int:
    """The largest size up to which enumerating subsets is cheaper than scanning lists."""
    counts = live.groupBy(F.least("size", F.lit(most)).alias("size")).agg(F.count("*").alias("n"), F.sum(F.size("grams")).alias("grams")).collect()  # at most `most` rows
    lists = live.agg(F.sum(F.col("score") * F.col("size")) / F.sum(F.size("grams"))).first()[0]
    reach = 2 ** (lists or 1)  # geometric mean length of the lists
    out = 0
    for r in sorted(counts, key=lambda r: r["size"]):
        s = r["size"]
        if s >= most or subset_cost(s, num, den) > max(2.0, (s - need(s, s, num, den) + 1) * reach):
            break
        out = s
    return out


def light_pairs(live: DataFrame, x: int, num: int, den: int) -> DataFrame:
    """Links among sets of at most ``x`` grams, as stars (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                out: list[list] = [[], [], [], []]
                for node, s, grams in zip(*(batch.slice(at, 500).column(i).to_pylist() for i in range(3))):
                    grams = sorted(grams)
                    for t in range(-(-num * s // den), min(x, den * s // num) + 1):
                        c = need(s, t, num, den)
                        if c <= min(t, len(grams)):
                            for sub in combinations(grams, c):
                                key = xxhash.xxh3_64_intdigest(np.array([min(s, t), max(s, t), *sub], np.int64).tobytes()) - (1 << 63)
                                for col, v in zip(out, (key, node, s <= t, s >= t)):
                                    col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.bool_()), pa.array(out[3], pa.bool_())], names=["key", "node", "low", "high"])

    subsets = live.where(F.col("size") <= x).select("node", "size", "grams").mapInArrow(run, "key long, node long, low boolean, high boolean")
    ends = subsets.groupBy("key").agg(F.min(F.when(F.col("low"), F.col("node"))).alias("low_end"), F.min(F.when(F.col("high"), F.col("node"))).alias("high_end"))
    ends = ends.where("low_end IS NOT NULL AND high_end IS NOT NULL")
    met = subsets.join(ends, "key")
    other = F.when(F.col("low"), F.col("high_end")).otherwise(F.col("low_end"))
    return met.select(F.col("node").alias("a"), other.alias("b")).where("a <> b").distinct()


def _overlap_ok(o: Column, a: Column, b: Column, num: int, den: int) -> Column:
    return o * (num + den) >= F.lit(num) * (a + b)


def verified(pairs: DataFrame, live: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose overlap reaches the threshold, counted on the live sets."""
    left = live.select(F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("grams").alias("grams_a"))
    right = live.select(F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("grams").alias("grams_b"))
    both = pairs.join(left, "a").join(right, "b")
    return both.where(_overlap_ok(F.size(F.array_intersect("grams_a", "grams_b")), F.col("size_a"), F.col("size_b"), num, den)).select("a", "b")


def block_pairs(rest: DataFrame, x: int, num: int, den: int) -> DataFrame:
    """Candidates (a, b) among the members of each list, by pairs of its ``blocks``; only those that pass the filters."""
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = rest.withColumn("i", mine).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("gram", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), F.col("i").cast("long").alias("i"), "node", "size", F.col("have").cast("long").alias("have"), F.col("pos").cast("long").alias("pos"), "root")
    parts = int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def compared(m: np.ndarray) -> np.ndarray:
        """Pairs of one task's members, given as columns (i, node, size, have, pos, root)."""
        i, node, size, have, pos, root = m
        one = i.min()
        p, q = (np.flatnonzero(i == one), np.flatnonzero(i != one)) if (i != one).any() else (np.arange(len(i)), np.arange(len(i)))
        a, b = size[p][:, None], size[q][None, :]
        most = np.minimum((have - pos)[p][:, None], (have - pos)[q][None, :])
        ok = (root[p][:, None] != root[q][None, :]) & (a * den >= b * num) & (b * den >= a * num) & (np.maximum(a, b) > x) & (most * (num + den) >= num * (a + b))
        u, v = np.nonzero(ok)
        u, v = node[p[u]], node[q[v]]
        return np.unique(np.stack((np.minimum(u, v), np.maximum(u, v))), axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((9, 0), np.int64)
        for batch in batches:
            held = np.concatenate((held, np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(9)])), axis=1)
            edge = np.flatnonzero((np.diff(held[:3], axis=1) != 0).any(axis=0)) + 1
            for a, b in zip([0, *edge[:-1].tolist()], edge.tolist()):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in compared(held[3:, a:b])], names=["a", "b"])
            held = held[:, edge[-1] :] if len(edge) else held
        if held.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in compared(held[3:])], names=["a", "b"])

    return dealt.repartition(parts, "gram", "lo", "hi").sortWithinPartitions("gram", "lo", "hi").mapInArrow(run, "a long, b long")


def links(docs: DataFrame, *, n: int = 5, threshold: tuple[int, int] = (80, 100), text_col: str = "text") -> DataFrame:
    """(node, root) of all nodes that link with another."""
    g = math.gcd(*threshold)
    num, den = threshold[0] // g, threshold[1] // g
    live = cut(live_sets(docs, n=n, num=num, den=den, text_col=text_col), "live")
    x = boundary(live, num, den)
    light = light_pairs(live, x, num, den)
    # prefix: what remains after dropping as many grams as a partner must share, less one; unshared grams stand first
    prefix = (F.col("size") - F.ceil(F.col("size") * num / F.lit(den)) + 1 - (F.col("size") - F.size("grams"))).cast("int")
    heavy = live.where(F.col("size") * den > x * num).select("node", "size", "score", F.size("grams").alias("have"), F.posexplode(F.slice("grams", F.lit(1), F.greatest(prefix, F.lit(1)))).alias("pos", "gram"))
    lists = cut(heavy, "lists")
    fits = lambda a, b: (F.col(a) * den >= F.col(b) * num) & (F.col(b) * den >= F.col(a) * num) & (F.greatest(a, b) > x)

    # what is joined back is cut first: then Spark can split the partition of a long list
    hubs = lists.groupBy("gram").agg(F.max_by(F.struct("node", "size"), F.struct("score", "size", "node")).alias("hub"), F.count("*").alias("members")).where("members > 1")
    hubs = cut(hubs.select("gram", F.col("hub.node").alias("hub"), F.col("hub.size").alias("hub_size")), "hubs")
    star = lists.join(hubs, "gram").where((F.col("node") != F.col("hub")) & fits("size", "hub_size"))
    pairs = star.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    known = cut(light.unionByName(verified(pairs, live, num, den)), "links")
    roots = components(known, "a", "b")

    placed = cut(lists.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).drop("score"), "placed")
    several = placed.groupBy("gram").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("members")).where("r0 <> r1")
    several = cut(several.select("gram", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks")), "several")
    more = cut(verified(block_pairs(placed.join(several, "gram"), x, num, den).distinct(), live, num, den), "links")
    if more.isEmpty():
        return roots
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more), "a", "b")


def join(docs: DataFrame, *, n: int = 5, threshold: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) per row of ``docs``."""
    require_integer(docs, id_col)
    rows = cut(nodes(docs, n=n, id_col=id_col, text_col=text_col), "nodes")
    roots = links(docs, n=n, threshold=threshold, text_col=text_col)
    # empty sets link with nothing: each stays alone
    first = rows.where("size > 0").groupBy("node").agg(F.min("id").alias("first"))
    placed = first.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    least = cut(placed.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    label = placed.join(least, "root").select("node", "component_id", F.lit(True).alias("_set"))
    out = rows.join(label, "node", "left")
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that are linked, directly or through others, with one of smaller id.

    Documents without words and those with a null id stay. Rows that repeat an id stay or go together, by the smallest
    component that one of them is in.
    """
    labels = join(docs.select(id_col, text_col), id_col=id_col, text_col=text_col, **options)
    gone = labels.where(F.col("component_id") < F.col(id_col)).select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
