"""Prefix trie of conversations, as balanced parentheses in shards.

Nodes are the distinct beginnings of conversations (turn by turn, role and text). Turns travel as 128 bits of SHA-256 and a
length, never as texts; a conversation's path is its turns' hashes in a row, so sorting paths as bytes is the trie's own
order. Ranges of sorted paths are shards: each writes its part of the trie as balanced parentheses, finds where subtrees
end by the excess over blocks with their minima in a tree (``Parentheses.close``), counts leaves as pairs ``()`` by rank,
and takes what a subtree holds from cumulative arrays. The nodes on a shard's first and last path, its *spine*, may go on in
other shards: their parts are merged by the hash of the path from the root, and subtotals are passed up the merged spines,
for each child of the root on its own. All other nodes are whole within their shard.

Defined cases: conversations are sorted by turn (null first), then by the hash of role and text; null role and text are
empty; rows that repeat are turns that repeat; rows without a conversation id belong to no conversation and are left out; an empty table has no
nodes, not even a root; other columns are not looked at. Ids must be integers. What a task holds: the hashed turns of one group
of ``of`` conversations, and a shard of ``SHARD`` nodes or one conversation. The ids of all conversations that end at a node
go sorted through one task as a stream, as one SHA-256 over them is in sequence by its nature.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from countloom.llm.common import require_integer
from countloom.session import cut

#: Bytes of a turn's hash, nodes of a shard, positions of a block of excess, spine nodes that a broadcast may hold (32 bytes each).
WIDTH, SHARD, BLOCK, FEW = 16, 200_000, 64, 500_000
NO_ENDS = hashlib.sha256(b"").hexdigest()


def rebuilt(conversations: DataFrame, *, of: int = 5, most: int = 9) -> DataFrame:
    """(conv_id, path, sizes): the first h turns of conversation ``c - c % of``, then c's own after its first h; h = crc32(c) % most."""
    require_integer(conversations, "conv_id")
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    said = F.sha2(F.encode(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), "UTF-8"), 256)
    turn = F.struct(F.col("conv_id").alias("c"), F.col("turn").isNotNull(), "turn", F.substring(said, 1, 2 * WIDTH).alias("h"), F.octet_length(text).cast("long").alias("n"))
    rows = conversations.where("conv_id IS NOT NULL").select((F.col("conv_id") - F.col("conv_id") % of).alias("base"), turn.alias("t"))
    groups = rows.groupBy("base").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    each = groups.select("base", "ts", F.explode(F.array_distinct(F.transform("ts", lambda t: t["c"]))).alias("conv_id"))
    taken = (F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % most).cast("int")
    own, first = F.filter("ts", lambda t: t["c"] == F.col("conv_id")), F.filter("ts", lambda t: t["c"] == F.col("base"))
    turns = each.select("conv_id", F.concat(F.slice(first, 1, taken), F.slice(own, taken + 1, F.size("ts"))).alias("turns"))
    return turns.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["h"]), "")).alias("path"), F.transform("turns", lambda t: t["n"]).alias("sizes"))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (path, conv_id, sizes) -> a row for each path: how many, the smallest id, SHA-256 of the ids."""
    names, now, out = ["path", "sizes", "n", "conv_id", "sha"], None, []

    def close() -> None:
        out.append((now[0], now[1], now[2], now[3], now[4].hexdigest()))

    def flush() -> pa.RecordBatch:
        kinds = (pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string())
        made = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=names)
        out.clear()
        return made

    for batch in batches:
        paths, ids, sizes = batch.column(0), batch.column(1).to_pylist(), batch.column(2)
        for i, (path, c) in enumerate(zip(paths.to_pylist(), ids)):
            if now is not None and now[0] == path:
                now[2] += 1
                now[4].update(b",%d" % c)
                continue
            if now is not None:
                close()
            now = [path, sizes[i].as_py(), 1, c, hashlib.sha256(b"%d" % c)]
            if len(out) >= 2000:
                yield flush()
    if now is not None:
        close()
    if out:
        yield flush()


class Parentheses:
    """Balanced parentheses (1 opens, 0 closes) with the excess after each, its least by block and a tree of these."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.excess = np.cumsum(np.where(bits, 1, -1)).astype(np.int32)
        n = -(-len(bits) // BLOCK)
        padded = np.full(n * BLOCK, np.iinfo(np.int32).max, np.int32)
        padded[: len(bits)] = self.excess
        self.blocks = padded.reshape(n, BLOCK)
        self.tree = [self.blocks.min(1)]
        while len(self.tree[-1]) > 1:
            low = self.tree[-1]
            low = np.append(low, np.iinfo(np.int32).max) if len(low) % 2 else low
            self.tree[-1] = low
            self.tree.append(low.reshape(-1, 2).min(1))

    def close(self, opens: np.ndarray) -> np.ndarray:
        """The place of the parenthesis that closes each of ``opens``."""
        out = np.full(len(opens), -1)
        want = self.excess[opens] - 1
        left = np.arange(len(opens))
        for step in range(1, BLOCK):  # in the same block
            at = opens[left] + step
            inside = at // BLOCK == opens[left] // BLOCK
            left, at = left[inside], at[inside]
            if not len(left):
                break
            hit = self.excess[np.minimum(at, len(self.excess) - 1)] == want[left]
            out[left[hit]] = at[hit]
            left = left[~hit]
        left = np.flatnonzero(out < 0)
        node, level, up = opens[left] // BLOCK, np.zeros(len(left), np.int64), np.arange(len(left))
        for k in range(len(self.tree) - 1):  # up, until a block to the right goes low enough
            right = (node[up] % 2 == 0) & (self.tree[k][node[up] | 1] <= want[left[up]])
            node[up[right]] += 1
            level[up[right]] = k
            up = up[~right]
            node[up] //= 2
        for k in range(len(self.tree) - 1, 0, -1):  # and down to the first such block
            down = np.flatnonzero(level == k)
            node[down] *= 2
            node[down] += self.tree[k - 1][node[down]] > want[left[down]]
            level[down] = k - 1
        for a in range(0, len(left), 1 << 16):
            some = slice(a, a + (1 << 16))
            out[left[some]] = node[some] * BLOCK + (self.blocks[node[some]] == want[left[some], None]).argmax(1)
        return out


def _least(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The least of values[start:stop], for many non-empty ranges, from minima over powers of two."""
    out, size = np.empty(len(start), values.dtype), stop - start
    power, now, k = np.log2(size).astype(int), values, 0
    while True:
        at = power == k
        out[at] = np.minimum(now[start[at]], now[stop[at] - (1 << k)])
        if not (power > k).any():
            return out
        now, k = np.minimum(now[: -(1 << k)], now[1 << k :]), k + 1


_KINDS = {
    "spine": pa.bool_(), "id": pa.binary(), "parent_id": pa.binary(), "top": pa.binary(), "conv_id": pa.int64(), "depth": pa.int64(), "parent_conv_id": pa.int64(), "n_convs": pa.int64(),
    "n_children": pa.int64(), "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "bytes": pa.int64(), "ends_sha256": pa.string(),
}
_SCHEMA = "spine boolean, id binary, parent_id binary, top binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, bytes long, ends_sha256 string"


def _shard(rows: list[tuple]) -> pa.RecordBatch:
    """The nodes of sorted distinct paths (path, sizes, n, conv_id, sha)."""
    bits, depth, size, parent, stack = bytearray(b"\1"), [0], [0], [-1], [0]
    ends, before = [], b""
    for path, sizes, *_ in rows:
        d, most = 0, min(len(path), len(before)) // WIDTH
        while d < most and path[d * WIDTH : (d + 1) * WIDTH] == before[d * WIDTH : (d + 1) * WIDTH]:
            d += 1
        bits += bytes(len(stack) - 1 - d)
        del stack[d + 1 :]
        for x in sizes[d:]:
            bits.append(1)
            parent.append(stack[-1])
            stack.append(len(depth))
            depth.append(len(stack) - 1)
            size.append(x)
        ends.append(stack[-1])
        before = path
    bits += bytes(len(stack))
    n, b = len(depth), np.frombuffer(bits, np.uint8)
    parent, depth, size = np.array(parent), np.array(depth), np.array(size, np.int64)
    spine = np.zeros(n, bool)
    spine[: len(rows[0][0]) // WIDTH + 1] = spine[stack] = True

    opens = np.flatnonzero(b)
    close = Parentheses(b).close(opens)
    stop = np.cumsum(b)[close]  # nodes opened until the subtree ends
    until = lambda x: np.concatenate(([0], np.cumsum(x)))
    own, low, sha = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, None, object)
    own[ends], low[ends], sha[ends] = [r[2] for r in rows], [r[3] for r in rows], [r[4] for r in rows]
    convs = until(own)
    n_convs = convs[stop] - convs[:-1]
    pair = b[:-1] > b[1:]
    pair[opens[spine]] = False  # these may have children elsewhere
    pairs = until(pair)
    n_leaves = pairs[close] - pairs[opens]
    saved = until(np.where(spine, 0, (n_convs - 1) * size))
    least = _least(low, np.arange(n), stop)

    id_of: dict[int, bytes] = {0: b""}
    for path in (rows[0][0], rows[-1][0]):
        at, name, chain = 0, b"", list(range(1, len(path) // WIDTH + 1)) if path is rows[0][0] else stack[1:]
        for d, at in enumerate(chain):
            name = hashlib.sha256(name + path[d * WIDTH : (d + 1) * WIDTH]).digest()[:16]
            id_of[at] = name
    top_of = {at: None if at == 0 else at for at in id_of}
    for at in sorted(id_of):
        if depth[at] > 1:
            top_of[at] = top_of[int(parent[at])]
    ids, parents, tops = (np.full(n, None, object) for _ in range(3))
    for at, name in id_of.items():
        ids[at] = name
        parents[at] = id_of[int(parent[at])] if at else None
        tops[at] = id_of[top_of[at]] if at else None
    hang = np.flatnonzero(~spine & spine[parent])
    parents[hang] = [id_of[p] for p in parent[hang].tolist()]
    known = ~spine & ~spine[parent]
    cols = {
        "spine": spine, "id": ids, "parent_id": parents, "top": tops, "conv_id": least, "depth": depth, "n_convs": n_convs,
        "n_children": np.bincount(parent[~spine], minlength=n), "n_leaves": n_leaves, "saved_tokens": saved[stop] - saved[:-1], "bytes": size, "ends_sha256": sha,
    }
    cols["parent_conv_id"] = pa.array(least[parent], pa.int64(), mask=~known)
    return pa.RecordBatch.from_arrays([x if isinstance(x := cols[k], pa.Array) else pa.array(x, kind) for k, kind in _KINDS.items()], names=list(_KINDS))


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    rows, nodes = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            rows.append(row)
            nodes += len(row[1])
            if nodes >= most:
                yield _shard(rows)
                rows, nodes = [], 0
    if rows:
        yield _shard(rows)


def _up(part: pd.DataFrame) -> pd.DataFrame:
    """Merged spine nodes below one child of the root: what spine nodes have in spine subtrees is passed up, deepest first."""
    part = part.sort_values("depth", ascending=False, ignore_index=True)
    at = {i: k for k, i in enumerate(part["id"])}
    up = np.array([at.get(p, -1) for p in part["parent_id"]])
    depth, convs, size = (part[c].to_numpy() for c in ("depth", "n_convs", "bytes"))
    children, own = part["n_children"].to_numpy().copy(), (convs - 1) * size
    leaves, saved = np.zeros_like(children), own.copy()  # of spine nodes; the parts hold the others
    edge = np.flatnonzero(np.diff(depth, prepend=-1, append=-1))
    for a, b in zip(edge, edge[1:]):
        leaves[a:b] += children[a:b] == 0
        some = np.flatnonzero(up[a:b] >= 0) + a
        for total, x in ((children, np.ones_like(children)), (leaves, leaves), (saved, saved)):
            np.add.at(total, up[some], x[some])
    conv = part["conv_id"].to_numpy()
    above = pd.array(np.where(up >= 0, conv[up], 0), "Int64")
    above[up < 0] = pd.NA
    return part.assign(n_children=children, n_leaves=part["n_leaves"] + leaves, saved_tokens=part["saved_tokens"] + saved, parent_conv_id=above, own=own)[[*_NODE, "own"]]


_NODE = ["id", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
_NODE_SCHEMA = "id binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def trie(paths: DataFrame, shard: int = SHARD) -> DataFrame:
    """A row for each node of the conversations (conv_id, path, sizes); ``shard``: nodes of a shard.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (bytes of turns that
    are the same again, over the subtree), ends_sha256 (of the ids of those that end here).
    """
    kinds = "path binary, sizes array<long>, n long, conv_id long, sha string"
    rows = paths.select("path", F.col("conv_id").cast("long").alias("conv_id"), "sizes").repartition("path").sortWithinPartitions("path", "conv_id")
    distinct = cut(rows.mapInArrow(_ends, kinds), "paths")
    nodes = cut(distinct.repartitionByRange("path").sortWithinPartitions("path").mapInArrow(lambda batches: _shards(batches, shard), _SCHEMA), "nodes")

    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    same = [F.first(c).alias(c) for c in ("parent_id", "top", "depth", "bytes")]
    merged = nodes.where("spine").groupBy("id").agg(*same, F.min("conv_id").alias("conv_id"), *sums, F.max("ends_sha256").alias("ends_sha256"))
    merged = cut(merged, "spines")
    below = merged.where("depth > 0").groupBy("top").applyInPandas(_up, _NODE_SCHEMA + ", own long")
    below = cut(below, "spines-up")
    first = below.agg(F.count_if(F.col("depth") == 1).alias("c"), F.count_if(F.col("n_children") == 0).alias("l"), F.coalesce(F.sum("own"), F.lit(0)).alias("s"))
    root = merged.where("depth = 0").crossJoin(first)  # one row each
    children = F.col("n_children") + F.col("c")
    root = root.select("id", "conv_id", "depth", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", children.alias("n_children"), (F.col("n_leaves") + F.col("l") + (children == 0).cast("long")).alias("n_leaves"), (F.col("saved_tokens") + F.col("s")).alias("saved_tokens"), "ends_sha256")
    top = root.select(F.col("conv_id").alias("root_conv"))
    below = below.crossJoin(top).withColumn("parent_conv_id", F.coalesce("parent_conv_id", "root_conv")).select(*_NODE)

    names = merged.select(F.col("id").alias("parent_id"), F.col("conv_id").alias("above"))
    names = F.broadcast(names) if merged.count() <= FEW else names
    whole = nodes.where("NOT spine")
    hanging = whole.where("parent_id IS NOT NULL").join(names, "parent_id").withColumn("parent_conv_id", F.col("above")).select(*_NODE)
    out = whole.where("parent_id IS NULL").select(*_NODE).unionByName(hanging).unionByName(below).unionByName(root)
    return out.select(*_NODE[1:-1], F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
