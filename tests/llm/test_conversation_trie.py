"""The trie against brute force."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from countloom.llm import conversation_trie as trie, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [x[2:] for x in sorted(t)] for c, t in convs.items()}
    nodes = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        full = tuple(convs.get(c - c % 5, [])[:h] + own[h:])
        for d in range(len(full) + 1):
            node = nodes.setdefault(full[:d], [[], []])
            node[0].append(c)
            if d == len(full):
                node[1].append(c)
    out = []
    for key, (members, ends) in nodes.items():
        below = [k for k in nodes if k[: len(key)] == key]
        childless = lambda k: not any(len(x) == len(k) + 1 and x[: len(k)] == k for x in below)
        out.append((
            min(members), len(key), min(nodes[key[:-1]][0]) if key else None, len(members), sum(len(x) == len(key) + 1 for x in below), sum(map(childless, below)),
            sum((len(nodes[k][0]) - 1) * len(k[-1][1].encode()) for k in below if k), hashlib.sha256(",".join(map(str, sorted(ends))).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def run(spark, rows, schema=SCHEMA, shard=trie.SHARD):
    return sorted(map(tuple, trie.trie(trie.rebuilt(spark.createDataFrame(rows, schema)), shard).collect()), key=repr)


def test_query(spark):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet'").fetchall()
    got = queries.QUERIES["op13_conversation_trie"](spark, SF)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("seed", range(4))
def test_random(spark, seed):
    """Few different turns, so that much is shared; one hot conversation and one hot path; nulls, ties and repeats."""
    rnd = random.Random(seed)
    rows = [(c, t if rnd.random() < 0.9 else None, rnd.choice(["user", "bot", None]), rnd.choice(["a", "é", "", None, "b" * 9])) for c in range(60) for t in range(rnd.randrange(1, 9))]
    rows = [r for i, r in enumerate(rows) if sum(x[:2] == r[:2] for x in rows[:i]) == 0]  # ties go by hash, which is no order of texts
    rows += [(500, t, "user", rnd.choice("ab")) for t in range(150)] + [(1000 + i, 0, "user", "same") for i in range(100)] + [(None, 1, "user", "nobody")]
    rnd.shuffle(rows)
    assert run(spark, rows, shard=(40, 200, 3, trie.SHARD)[seed]) == brute(rows)


def test_edges(spark, monkeypatch):
    assert run(spark, []) == []
    assert run(spark, [(1, 0, "user", "gone")]) == brute([(1, 0, "user", "gone")])  # its base is absent and its own turn is taken away: it ends at the root
    monkeypatch.setattr(trie, "FEW", 0)
    rows = [(c, t, "u", f"{c % 3}{t}" + "long " * 20_000 * (c == 4)) for c in range(20) for t in range(3)]
    assert run(spark, [(*r, 1, b"x") for r in rows], SCHEMA + ", path int, sizes binary") == brute(rows)
    twice = [(0, 1, "u", "x")] * 2
    assert run(spark, twice) == brute(twice)
    with pytest.raises(TypeError):
        trie.rebuilt(spark.createDataFrame([("a", 1, "u", "x")], SCHEMA.replace("conv_id long", "conv_id string")))


def test_parentheses():
    rnd = random.Random(5)
    for n in (1, 2, 3, 64, 1000, 5000):
        for deep in (0.1, 0.5, 0.9):
            bits, depth = [1], 1
            for _ in range(n):
                if depth == 1 or rnd.random() < deep:
                    bits.append(1)
                    depth += 1
                else:
                    bits.append(0)
                    depth -= 1
            bits += [0] * depth
            stack, want = [], {}
            for i, x in enumerate(bits):
                if x:
                    stack.append(i)
                else:
                    want[stack.pop()] = i
            b = np.array(bits, np.uint8)
            opens = np.flatnonzero(b)
            assert trie.Parentheses(b).close(opens).tolist() == [want[i] for i in opens.tolist()]
